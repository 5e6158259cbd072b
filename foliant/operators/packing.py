"""Packs: files into archives of bounded size, and archives back into files, with every byte checked."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards, paths
from ..sources import archives
from . import effects, staging

PACKED = "archive string, content binary, members bigint, bytes bigint, sha256 string"
WRITTEN = "name string, action string, result string"


def volumes(files: DataFrame, key: str, most_bytes: int = 256 << 20) -> DataFrame:
    """files with ``archive``: key and volume number, so many volumes that each has about ``most_bytes`` or less.

    A key that holds a third of all files becomes many archives instead of one task.
    """
    total = files.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / most_bytes)).alias("_n"))
    number = F.pmod(F.xxhash64("rel"), F.col("_n"))
    return files.join(total, key).withColumn("archive", F.concat_ws("-", F.col(key).cast("string"), F.lpad(number.cast("string"), 4, "0"))).drop("_n")


def _archive(members: list[tuple[str, bytes]], kind: str) -> bytes:
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def packed(files: DataFrame, kind: str = "zip") -> DataFrame:
    """archive, content, members, bytes, sha256 of files (archive, rel, content): members in the order of rel, read again before they count."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        members = [(r.rel, bytes(r.content)) for r in rows.sort_values("rel").itertuples()]
        data = _archive(members, kind)
        found = [(m[1], m[3]) for m in archives.members(rows["archive"].iloc[0], data)]
        if found != [(name, hashlib.sha256(body).hexdigest()) for name, body in members]:
            raise ValueError(f"{rows['archive'].iloc[0]}: the archive does not give its files back")
        return pd.DataFrame([(rows["archive"].iloc[0], data, len(members), sum(len(b) for _, b in members), hashlib.sha256(data).hexdigest())], columns=["archive", "content", "members", "bytes", "sha256"])

    return files.select("archive", "rel", "content").groupBy("archive").applyInPandas(run, PACKED)


def member_actions(members: DataFrame, existing: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """members (path, name, size, sha256, reason) with ``action``: what unpacking would do where ``existing`` (rel, kind, size, sha256) lies."""
    marked = archives.mark_repeats(members.withColumn("reason", F.coalesce("reason", paths.archive_member_reason(F.col("name")))))
    own = marked.withColumn("_rel", paths.canonical_member(F.col("name")))
    none = F.array().cast("array<string>")
    own = own.withColumn("reason", F.coalesce("reason", F.when(guards.escapes(F.col("_rel"), none), "escapes")))
    # a member below a link of the target, or named like one, would be written elsewhere
    parts = F.split("_rel", "/")
    heads = own.select("path", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("head"))
    out = heads.join(existing.filter("kind = 'link'").select(F.col("rel").alias("head")), "head", "left_semi").select("path", "ord", F.lit("escapes").alias("_out")).distinct()
    own = own.join(out, ["path", "ord"], "left").withColumn("reason", F.coalesce("reason", "_out")).drop("_out")
    there = existing.select(F.col("rel").alias("_there"), F.col("kind").alias("_kind"), F.col("size").alias("_size"), F.lower("sha256").alias("_sha"))
    joined = own.join(there, F.col("_rel") == F.col("_there"), "left")
    same = (F.col("_size") == F.col("size")) & (F.col("_sha") == F.col("sha256"))
    return joined.withColumn("action", staging.unpack_action(F.col("reason"), F.col("_kind"), same, on_conflict)).drop("_rel", "_there", "_kind", "_size", "_sha")


def extract(blobs: DataFrame, actions: DataFrame, target: str, *, dry_run: bool = True) -> DataFrame:
    """name, action, result of unpacking archives (path, content) by their members' actions; new files are read again.

    ``conflict-backup`` moves the old file aside first.  A repeated task finds its own files and leaves them.
    """
    plan = actions.groupBy("path").agg(F.collect_list(F.struct("name", "action", "sha256")).alias("plan"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, plan in zip(batch["content"], batch["plan"]):
                read = archives.reader(bytes(content))
                rows = []
                for m in plan:
                    name, action, sha = m["name"], m["action"], m["sha256"]
                    dest = os.path.join(target, *[p for p in name.replace("\\", "/").split("/") if p not in ("", ".")])
                    result = f"would write ({action})" if dry_run else "left"
                    if action in ("new", "conflict-backup") and not dry_run:
                        if os.path.exists(dest):
                            if effects.digest(dest) == sha:
                                rows.append((name, action, "unchanged"))
                                continue
                            effects.backup(dest)
                        effects.write_stream(dest, [read(name)])
                        result = "written" if effects.digest(dest) == sha else "differs"
                    elif action not in ("new", "conflict-backup"):
                        result = "left"
                    rows.append((name, action, result))
                yield pd.DataFrame(rows, columns=["name", "action", "result"])

    return blobs.join(plan, "path").select("content", "plan").mapInPandas(run, WRITTEN)


def against_manifest(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """rel, problem: members missing from the archive, not in the manifest, or of another size or digest."""
    return staging.manifest_diff(manifest, members.filter("reason IS NULL").select(paths.canonical_member(F.col("name")).alias("rel"), "size", "sha256"))


def extra_files(target: DataFrame, members: DataFrame) -> DataFrame:
    """Files of a target (rel) that no member names."""
    return target.select("rel").join(members.select(paths.canonical_member(F.col("name")).alias("rel")), "rel", "left_anti")


def kept_and_excluded(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files (relpath) with ``excluded``: the first glob that fits, null for those that stay."""
    return files.withColumn("excluded", guards.excluded_by(F.col("relpath"), patterns))
