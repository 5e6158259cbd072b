"""Which roots hold which paths: a path's ancestors are keys, so containment is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .tables import sized


def _key(path: Column) -> Column:
    """Lower case, slashes, none at the end; the root of everything is empty."""
    return F.rtrim(F.lower(paths.posix(path)), F.lit("/"))


def ancestors(path: Column) -> Column:
    """The keys of a path and of all folders above it, from the top (``''``) down."""
    parts = F.split(_key(path), "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def holding(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """``rows`` with each root (all columns of ``roots``) that is their path or lies above it, in any case; /a/bc is not in /a/b.

    A row is as many keys as its path has parts, whatever the number of roots.  Null and empty paths or roots meet nothing.
    """
    keys = rows.filter(F.col(path) != "").withColumn("_up", F.explode(ancestors(F.col(path))))
    tops = roots.filter(F.col(root) != "").withColumn("_top", _key(F.col(root)))
    return keys.join(sized(tops), F.col("_up") == F.col("_top")).drop("_up", "_top")


def innermost(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Distinct path and the deepest root that holds it; paths in no root don't come."""
    found = holding(rows.select(path).distinct(), roots.select(root), path, root)
    return found.groupBy(path).agg(F.max_by(root, F.struct(F.length(_key(F.col(root))), F.col(root))).alias(root))


def overlaps(roots: DataFrame, root: str = "root", role: str = "role") -> DataFrame:
    """outer, outer_role, inner, inner_role: pairs of roots (root, role) of which one holds the other; equal ones once each way of roles."""
    inner = roots.select(F.col(root).alias("inner"), F.col(role).alias("inner_role")).distinct()
    outer = roots.select(F.col(root).alias("outer"), F.col(role).alias("outer_role")).distinct()
    both = holding(inner, outer, "inner", "outer")
    same = F.col("inner").eqNullSafe(F.col("outer")) & F.col("inner_role").eqNullSafe(F.col("outer_role"))
    return both.filter(~same).select("outer", "outer_role", "inner", "inner_role")


def setting_problems(roots: DataFrame, config: DataFrame) -> DataFrame:
    """path, problem of a library's settings: roots (root, role: source or destination, exists, is_folder) and config files (path).

    missing or no folder: a source that isn't there or is a file, a destination that is a file; overlap: a source in a
    destination or the other way round; config inside: a settings file that a copy or a rename could overwrite.
    """
    there, folder = F.coalesce("exists", F.lit(False)), F.coalesce("is_folder", F.lit(False))
    own = roots.select(F.col("root").alias("path"), F.when((F.col("role") == "source") & ~there, "missing").when(there & ~folder, "no folder").alias("problem")).filter("problem IS NOT NULL")
    across = overlaps(roots).filter("outer_role <> inner_role").select(F.explode(F.array("outer", "inner")).alias("path"), F.lit("overlap").alias("problem"))
    inside = holding(config.select("path"), roots.select("root")).select("path", F.lit("config inside").alias("problem"))
    return own.unionByName(across).unionByName(inside).distinct()
