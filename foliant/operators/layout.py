"""Destinations: layout templates, collisions, sidecars beside their parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .tables import written

# The named templates and the extension groups.
LAYOUTS = {
    "keep_relpath": "{library_root}/{source_name}/{relpath}",
    "by_year": "{library_root}/screenshots/{year}/{stem}{ext}",
    "by_year_month": "{library_root}/photos/{year}/{month}/{stem}{ext}",
    "pack_tree": "{library_root}/packs/{bundle}/{pack}/{relpath_from_pack}",
    "by_ext": "{library_root}/by-ext/{ext_name}/{stem}{ext}",
    "sidecar_with_parent": "{parent_dir}/_notes/{stem}{ext}",
    "zip_store": "{library_root}/_zips/{bundle}/{zip_name}",
}
SIDECARS = (".txt", ".md", ".pdf", ".docx", ".nfo", ".json", ".html", ".url")
ARCHIVES = (".zip", ".7z", ".rar")


def tokens(library_root: str, quarantine: str, parent_dir: Column | None = None, relpath: Column | None = None) -> dict[str, Column]:
    """The values that templates may name, over inventory columns."""
    c = F.col
    return {
        "library_root": F.lit(library_root),
        "quarantine": F.lit(quarantine),
        "source_name": c("source_name"),
        "relpath": paths.posix(c("relpath") if relpath is None else relpath),
        "stem": c("stem"),
        "ext": F.coalesce("ext", F.lit("")),
        "ext_name": F.regexp_replace(F.coalesce("ext", F.lit("")), r"^\.", ""),
        "bundle": F.coalesce("bundle", F.lit("_unknown")),
        "pack": F.coalesce("pack", F.lit("_root")),
        "relpath_from_pack": paths.posix(F.coalesce("from_pack", "relpath")),
        "year": F.coalesce("year", F.lit("0000")),
        "month": F.coalesce("month", F.lit("00")),
        "zip_name": F.concat("stem", F.coalesce("ext", F.lit(""))),
        "parent_dir": F.lit("") if parent_dir is None else parent_dir,
        "group": F.coalesce("group_name", F.lit("")),
    }


def destination(layout: Column, values: dict[str, Column], layouts: dict[str, str] = LAYOUTS) -> Column:
    """The rendered template of each row's layout; an unknown layout fails the query."""
    chain = reduce(lambda acc, x: acc.when(layout == x[0], paths.render(x[1], values)), layouts.items(), F.when(F.lit(False), F.lit("")))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown layout: "), layout)))


def renamed_on_collision(rows: DataFrame, *order: Column, dest: str = "dest", id_col: str = "id") -> DataFrame:
    """From the second row of a destination on, ``stem__id`` and a note in ``reason``.

    Only who comes first matters, and that is a minimum: no window has to hold a crowded destination's rows.
    """
    rank = F.struct(*order, F.col(id_col))
    first = rows.groupBy(dest).agg(F.min(rank).alias("_first"))
    late = F.col("_first") != rank
    return (
        rows.join(first, dest)
        .withColumn("reason", F.when(late, F.concat("reason", F.lit("; dest collision renamed"))).otherwise(F.col("reason")))
        .withColumn(dest, F.when(late, paths.with_marked_stem(F.col(dest), F.concat(F.lit("__"), F.col(id_col)))).otherwise(F.col(dest)))
        .drop("_first")
    )


def plan(files: DataFrame, duplicates: DataFrame, parents: DataFrame, *, library_root: str = "/library", quarantine: str = "/quarantine", default_op: str = "copy") -> DataFrame:
    """file_id, src, dest, op, reason for every file.

    Files that are no sidecars come first: extra copies go to quarantine, archives to the zip store, others
    where their source's layout says.  Sidecars (``parents``: id, parent_id) follow beside their parent's
    destination, or under _unsorted if it has none.  Destinations outside both roots fail the query.
    """
    known = duplicates.select("sha256", "canonical_id")
    used = ("id", "path", "source_name", "priority", "layout", "relpath", "stem", "ext", "bundle", "pack", "from_pack", "year", "month", "group_name")
    # the inventory is digested once; both passes read this table
    marked = written(files.join(known, "sha256", "left").select(*used, "canonical_id", (F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("id"))).alias("extra")), "inventory")
    apart = F.concat_ws("/", F.lit(quarantine), F.col("source_name"), F.col("relpath"))
    values = tokens(library_root, quarantine)
    is_side = F.lower("ext").isin(*SIDECARS)
    main = marked.filter(~is_side).select(
        "id", "path", "priority",
        F.when(F.col("extra"), apart).when(F.lower("ext").isin(*ARCHIVES), paths.render(LAYOUTS["zip_store"], values)).otherwise(destination(F.col("layout"), values)).alias("dest"),
        F.when(F.col("extra"), "quarantine").otherwise(default_op).alias("op"),
        F.when(F.col("extra"), F.concat(F.lit("exact duplicate; canonical file_id="), F.col("canonical_id")))
        .when(F.lower("ext").isin(*ARCHIVES), "archive stored via zip_store").otherwise(F.concat(F.lit("layout "), F.col("layout"))).alias("reason"),
        F.lit(0).alias("pass"),
    )
    order = (F.col("pass"), -F.col("priority"))
    placed = written(renamed_on_collision(main, *order), "placed")
    homes = placed.select(F.col("id").alias("parent_id"), paths.parent(F.col("dest")).alias("parent_dir"))
    side = marked.filter(is_side).join(parents.select("id", "parent_id"), "id", "left").join(homes, "parent_id", "left")
    orphan = F.col("parent_dir").isNull()
    side = side.select(
        "id", "path", "priority",
        F.when(F.col("extra"), F.concat_ws("/", F.lit(quarantine), F.col("source_name"), F.when(orphan, F.concat(F.lit("_unsorted/"), F.col("relpath"))).otherwise(F.col("relpath"))))
        .when(orphan, paths.render(LAYOUTS["keep_relpath"], tokens(library_root, quarantine, relpath=F.concat(F.lit("_unsorted/"), F.col("relpath")))))
        .otherwise(paths.render(LAYOUTS["sidecar_with_parent"], tokens(library_root, quarantine, F.col("parent_dir")))).alias("dest"),
        F.when(F.col("extra"), "quarantine").otherwise(default_op).alias("op"),
        F.when(F.col("extra"), "exact duplicate sidecar").when(orphan, "orphan sidecar").otherwise("sidecar with parent").alias("reason"),
        F.lit(1).alias("pass"),
    )
    taken = placed.select("dest").distinct().withColumn("taken", F.lit(True))
    late = renamed_on_collision(side, *order).join(taken, "dest", "left")
    clash = F.col("taken").isNotNull() & ~F.col("reason").endswith("renamed")
    late = late.withColumn("reason", F.when(clash, F.concat("reason", F.lit("; dest collision renamed"))).otherwise(F.col("reason"))).withColumn(
        "dest", F.when(clash, paths.with_marked_stem(F.col("dest"), F.concat(F.lit("__"), F.col("id")))).otherwise(F.col("dest"))
    )
    both = placed.select("id", "path", "dest", "op", "reason").unionByName(late.select("id", "path", "dest", "op", "reason"))
    inside = paths.is_under(F.col("dest"), F.lit(library_root)) | paths.is_under(F.col("dest"), F.lit(quarantine))
    return both.select(F.col("id").alias("file_id"), F.col("path").alias("src"), F.when(inside, F.col("dest")).otherwise(F.raise_error(F.concat(F.lit("outside the library: "), F.col("dest")))).alias("dest"), "op", "reason")


def attach_sidecars(files: DataFrame) -> DataFrame:
    """id, parent_id of sidecar files: the first other file of the same source, folder and stem (null: orphan)."""
    keyed = files.withColumn("folder", paths.parent(F.col("relpath")))
    is_side = F.lower("ext").isin(*SIDECARS)
    parents = keyed.filter(~is_side).groupBy("source_name", "folder", "stem").agg(F.min("id").alias("parent_id"))
    return keyed.filter(is_side).join(parents, ["source_name", "folder", "stem"], "left").select("id", "parent_id")


def pair_archives(files: DataFrame) -> DataFrame:
    """id, paired: whether an archive's path without its suffix is a folder of the inventory."""
    folders = files.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)))).alias("n"), "path").select(F.array_join(F.slice(F.split("path", "/"), 1, F.col("n")), "/").alias("bare")).distinct()
    zips = files.filter(F.lower("ext").isin(*ARCHIVES)).withColumn("bare", F.left("path", F.length("path") - F.length("ext")))
    return zips.join(folders.withColumn("paired", F.lit(True)), "bare", "left").select("id", F.coalesce("paired", F.lit(False)).alias("paired"))
