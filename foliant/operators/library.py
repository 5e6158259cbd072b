"""Executing plans, dry by default, and rendering reports."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

OUTCOME = "file_id bigint, src string, dest string, op string, result string, note string"


def _digest(path: str) -> str:
    whole = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            whole.update(block)
    return whole.hexdigest()


def _place(src: str, dest: str, op: str) -> tuple[str, str]:
    """(result, note) of one row: never overwrites, never removes, and what it copies it reads again."""
    if not os.path.isfile(src):
        return "error", "source is missing"
    if os.path.exists(dest):
        same = os.path.isfile(dest) and os.path.getsize(dest) == os.path.getsize(src)
        return ("skipped", "already there") if same else ("error", "destination has another size")
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    if op == "hardlink":
        try:
            os.link(src, dest)
            return "hardlink", ""
        except OSError:
            pass  # another volume: copy
    part = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        shutil.copyfile(src, part)
        if _digest(part) != _digest(src):
            return "error", "the copy differs"
        os.link(part, dest)  # fails if something has come there meanwhile
    except FileExistsError:
        return "error", "destination appeared"
    except OSError as problem:
        return "error", str(problem)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return "quarantine" if op == "quarantine" else "copy", "copied from hardlink" if op == "hardlink" else ""


def apply_plan(plan: DataFrame, roots: list[str], *, dry_run: bool = True) -> DataFrame:
    """file_id, src, dest, op, result, note for each plan row (file_id, src, dest, op).

    Destinations outside ``roots`` are errors.  A dry run touches nothing and says ``would <op>``.  Otherwise
    executors act on files they all see; a repeated task finds its own copies and skips them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = [os.path.join(os.path.abspath(r), "") for r in roots]
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if not any(os.path.abspath(r.dest).startswith(t) for t in tops):
                    found = ("error", "outside the library")
                elif r.op == "skip":
                    found = ("skipped", "")
                elif dry_run:
                    found = (f"would {r.op}", "")
                else:
                    found = _place(r.src, r.dest, r.op)
                rows.append((r.file_id, r.src, r.dest, r.op, *found))
            yield pd.DataFrame(rows, columns=["file_id", "src", "dest", "op", "result", "note"])

    return plan.select("file_id", "src", "dest", "op").mapInPandas(run, OUTCOME)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("result").agg(F.count("*").alias("n"))


def check_manifest(entries: DataFrame, out_files: DataFrame) -> DataFrame:
    """rel, problem of a place manifest (src, dest, expected_dest, size, sha256) against the files (rel, size, sha256) of
    a job: missing source, other size or digest, another destination than the role's, files that no entry covers."""
    e, f = entries.alias("e"), out_files.alias("f")
    joined = e.join(f, F.col("e.src") == F.col("f.rel"), "left")
    problem = (
        F.when(F.col("f.rel").isNull(), "source is missing").when(F.col("e.size") != F.col("f.size"), "size differs")
        .when(F.lower("e.sha256") != F.lower("f.sha256"), "sha256 differs").when(F.col("e.dest") != F.col("e.expected_dest"), "unexpected destination")
    )
    loose = f.join(entries.select(F.col("src").alias("rel")), "rel", "left_anti").select("rel", F.lit("not in the manifest").alias("problem"))
    return joined.select(F.col("e.src").alias("rel"), problem.alias("problem")).filter("problem IS NOT NULL").unionByName(loose)


def validate_actions(actions: DataFrame) -> DataFrame:
    """actions with ``errors``: unknown op, relative paths, a source or destination that the op needs or must not have."""
    absolute = lambda c: c.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/)")
    needs_src, needs_dst = F.col("op").isin("copy", "move", "recycle"), F.col("op").isin("copy", "move", "mkdir")
    rules = [
        (~F.col("op").isin("mkdir", "copy", "move", "recycle"), "unknown op"),
        (needs_src & F.col("src").isNull(), "src is missing"),
        (needs_dst & F.col("dst").isNull(), "dst is missing"),
        ((F.col("op") == "mkdir") & F.col("src").isNotNull(), "src is not allowed"),
        ((F.col("op") == "recycle") & F.col("dst").isNotNull(), "dst is not allowed"),
        (F.col("src").isNotNull() & ~absolute(F.col("src")), "src is not absolute"),
        (F.col("dst").isNotNull() & ~absolute(F.col("dst")), "dst is not absolute"),
    ]
    return actions.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules])))


def retargeted(path: Column, old: str, new: str) -> Column:
    """A sibling's path for another marker: the token ``old`` (or ``pt<old>``) of its folders and name becomes ``new``
    in the same case."""
    token = F.lit(old.lower())

    def swap(t: Column) -> Column:
        lower = F.lower(t)
        upper = (F.upper(t) == t) & (lower != t)
        return (
            F.when(lower == token, F.when(upper, F.lit(new.upper())).otherwise(F.lit(new)))
            .when(lower == F.concat(F.lit("pt"), token), F.concat(F.left(t, F.lit(2)), F.lit(new))).otherwise(t)
        )

    inside = lambda part: F.array_join(F.transform(F.split(part, "_"), swap), "_")
    name = paths.file_name(path)
    folders = F.array_join(F.transform(F.split(paths.parent(path), "/"), inside), "/")
    return paths.join_path(folders, F.concat(inside(paths.stem(name)), paths.suffix(name)))


def summary_markdown(stats: dict, sources: list[dict], groups: list[dict], most: int = 50) -> str:
    """The report's first page; its inputs are small: totals, one row for each source, the top groups."""
    lines = ["# Summary", "", *[f"- {k}: {v:,}" for k, v in stats.items()], "", "## Sources", "", "| source | files | bytes |", "|---|---:|---:|"]
    lines += [f"| {s['source_name']} | {s['files']:,} | {s['bytes']:,} |" for s in sources]
    lines += ["", "## Largest duplicate groups", ""]
    lines += [f"- `{g['sha256'][:12]}` {g['extra_count']} extra, {g['wasted_bytes']:,} bytes; stays: {g['canonical_path']}" for g in groups[:most]]
    return "\n".join(lines) + "\n"


def exceptions_markdown(histogram: list[dict], orphans: list[str], errors: list[tuple[str, str]], most: int = 50) -> str:
    lines = ["# Exceptions", "", "## Ungrouped extensions", "", *[f"- {r['ext']}: {r['n']}" for r in sorted(histogram, key=lambda r: r["ext"])]]
    lines += ["", "## Orphaned sidecars", "", *[f"- {p}" for p in orphans[:most]], "", "## Errors", "", *[f"- {p}: {e}" for p, e in errors[:most]]]
    return "\n".join(lines) + "\n"
