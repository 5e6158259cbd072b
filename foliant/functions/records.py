"""Column functions that make records of plans, tags and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# Stars of each confidence, and image types whose stand-in keeps the type.
RATINGS = {"high": 5, "low": 2, "unsure": 0}
SAME_TYPE = (".jpg", ".jpeg", ".png")


def model_field(state: Column, label: Column) -> Column:
    """How a model took part: its state alone, with its label, or not called."""
    return F.when(state.isin("disabled", "unavailable"), state).when(F.coalesce(label, F.lit("")) != "", F.concat_ws("=", state, label)).otherwise(F.concat(state, F.lit(":not-called")))


def sidecar(bin_: Column, subbin: Column, confidence: Column) -> Column:
    """struct<subjects, label, rating> of a tagged file."""
    rating = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair]), confidence), F.lit(0))
    return F.struct(F.array_compact(F.array(bin_, F.nullif(subbin, F.lit("")))).alias("subjects"), bin_.alias("label"), rating.alias("rating"))


def standin_megabytes(size: Column, width: Column, height: Column, standin_width: Column, standin_height: Column) -> Column:
    """What a stand-in may weigh, by its share of the pixels; three decimals as text."""
    return F.format_string("%.3f", size * (standin_width * standin_height) / F.greatest(width * height, F.lit(1)) / (1024.0 * 1024.0))


def proxy_suffix(name: Column) -> Column:
    ext = F.lower(paths.suffix(name))
    return F.when(ext.isin(*SAME_TYPE), ext).otherwise(".jpg")


def action_text(parts: Column, zip_needed: Column) -> Column:
    """Fixed text: what a scan plans for one file."""
    return F.when(parts > 0, F.format_string("recreate %d parts + overview + zip", parts)).when(zip_needed, "overview + zip").otherwise("stand-in only")


def result_item(index: Column, op: Column, src: Column, dst: Column, sha256: Column, status: Column, reason: Column) -> Column:
    return F.struct(index.alias("index"), op.alias("op"), src.alias("src"), dst.alias("dst"), F.lower(sha256).alias("sha256"), status.alias("status"), reason.alias("reason"))


def family_key(tokens: Column) -> Column:
    """What the parts of one map share: all tokens but the last, or the only one."""
    return F.when(F.size(tokens) >= 2, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)


def source_name(path: Column) -> Column:
    """A source's name from its folder; a drive or a root is named by its letters."""
    plain = paths.posix(path)
    name = paths.file_name(F.rtrim(plain, F.lit("/")))
    root = F.regexp_replace(F.trim(F.replace(plain, F.lit(":"), F.lit("")), F.lit("/")), "/", "_")
    chosen = F.when((name == "") | name.endswith(":"), F.when(root == "", "root").otherwise(root)).otherwise(name)
    return F.regexp_replace(chosen, r'[<>:"/\\|?*\x00-\x1f]', "_")


def display_bytes(n: Column) -> Column:
    """1024-based for screens: a dash for null, one decimal from KB on."""
    out = F.format_string("%s B", n.cast("bigint").cast("string"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return F.when(n.isNull(), "—").otherwise(out)


def expected_place(target: str, rel: Column, role: Column) -> Column:
    """Where a job's file of a role belongs: archives of originals mirror the tree in their own folder."""
    stem = F.regexp_replace(F.trim(paths.stem(paths.file_name(rel))), r"[\s_]+", "_")
    mirrored = paths.join_path(F.lit(target), F.lit("_Originals_Zipped"), paths.parent(rel), F.concat(stem, F.lit(".zip")))
    return F.when(role == "original-zip", mirrored).otherwise(paths.join_path(F.lit(target), rel))


def backup_name(name: Column, old_sha: Column, held: Column) -> Column:
    """``name.sha.bak``, or with the least free number from 2 to 999 where ``held`` (array of names) has it; null if all are taken.

    One name more than are held is always enough to find a free one, so no more are made.
    """
    last = F.least(F.lit(999), F.size(held) + 2)
    names = F.concat(
        F.array(F.concat(name, F.lit("."), old_sha, F.lit(".bak"))),
        F.transform(F.sequence(F.lit(2), last), lambda k: F.concat(name, F.lit("."), old_sha, F.lit("."), k.cast("string"), F.lit(".bak"))),
    )
    return F.get(F.array_except(names, held), F.lit(0))
