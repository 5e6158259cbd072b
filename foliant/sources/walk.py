"""A distributed walk: folders are listed by executors, one level of all trees at a time.

Every name comes, those that begin with ``_`` or ``.`` as well.  What is not gone into says why: excluded names and
patterns, links, folders that can't be read.  The number of rounds is the depth of the deepest tree; a level's folders
are dealt over all executors, and each finished level is a written table.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import written
from .storage import resolve

ENTRIES = "root string, rel string, name string, kind string, size bigint, mtime double, dev bigint, inode bigint, way string, error string"
# Names that are never gone into.
EXCLUDED = ("node_modules", ".git", "__MACOSX", ".DS_Store")
#: Levels below a root; a file system's paths are shorter than that, so more means a fault.
DEEPEST = 200
#: Folders that one task lists, about.
FOLDERS = 500


def _excluded(rel: str, name: str, names: frozenset[str], globs: tuple[str, ...], any_case: bool) -> bool:
    """By its own name, or by a pattern over the relative path, the name, or the path of a folder that is all excluded."""
    own = name.lower() if any_case else name
    return own in names or any(fnmatchcase(rel, g) or fnmatchcase(name, g) or fnmatchcase(rel + "/", g) for g in globs)


def _local(folder: str, own: bool) -> Iterator[tuple]:
    """name, kind, size, mtime, dev, inode, way, error of each entry of a folder of this file system; ``own``: of itself, too.

    The ids of a link are those of what it leads to, and ``way`` says where that is.
    """
    if own:
        at = os.stat(folder)
        yield "", "root", None, at.st_mtime, at.st_dev, at.st_ino, None, None
    with os.scandir(folder) as found:
        for entry in found:
            try:
                at = entry.stat(follow_symlinks=False)
                kind = "dir" if stat.S_ISDIR(at.st_mode) else "file" if stat.S_ISREG(at.st_mode) else "other"
                way = entry.path if kind == "dir" else None
                if stat.S_ISLNK(at.st_mode) or os.path.isjunction(entry.path):
                    kind = "link"
                    if os.path.isdir(entry.path):
                        at, way = os.stat(entry.path), os.path.realpath(entry.path)
                yield entry.name, kind, at.st_size if kind == "file" else None, at.st_mtime, at.st_dev, at.st_ino, way, None
            except OSError as problem:
                yield entry.name, "error", None, None, None, None, None, _said(problem)


def _remote(system: pa.fs.FileSystem, folder: str, address: str) -> Iterator[tuple]:
    for entry in system.get_file_info(pa.fs.FileSelector(folder)):
        kind = {pa.fs.FileType.Directory: "dir", pa.fs.FileType.File: "file"}.get(entry.type, "other")
        size = entry.size if kind == "file" else None
        yield entry.base_name, kind, size, entry.mtime_ns / 1e9 if entry.mtime_ns else None, None, None, f"{address.rstrip('/')}/{entry.base_name}" if kind == "dir" else None, None


def _said(problem: OSError) -> str:
    return f"{type(problem).__name__}: {problem.strerror or problem}"


def _listed(address: str, own: bool) -> Iterator[tuple]:
    """Entries of a folder; one that can't be listed gives a single row without a name."""
    try:
        system, folder = resolve(address)
        yield from _local(folder, own) if isinstance(system, pa.fs.LocalFileSystem) else _remote(system, folder, address)
    except OSError as problem:
        yield "", "error", None, None, None, None, None, _said(problem)


def _level(frontier: DataFrame, names: frozenset[str], globs: tuple[str, ...], any_case: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for root, rel, address in zip(batch["root"], batch["rel"], batch["way"]):
                for name, kind, *more in _listed(address, rel == ""):
                    full = f"{rel}/{name}" if rel and name else rel or name
                    if kind in ("dir", "file", "link", "other") and _excluded(full, name, names, globs, any_case):
                        kind = "excluded"
                    rows.append((root, full, name, kind, *more))
                    if len(rows) >= 20_000:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)

    return frontier.mapInPandas(run, ENTRIES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    made = pd.DataFrame(rows, columns=columns, dtype=object)
    return made.astype({"size": "Int64", "dev": "Int64", "inode": "Int64", "mtime": "float64"})


def walk(roots: DataFrame, *, exclude: tuple[str, ...] = EXCLUDED, globs: tuple[str, ...] = (), any_case: bool = False, follow: bool = False) -> DataFrame:
    """root, rel, name, kind, size, mtime, dev, inode, error of everything below ``roots`` (root: an address).

    kind: file, dir, link (not followed), excluded (not gone into), other (pipes, devices), error.  A root that is
    missing, no folder or can't be read gives one error row with an empty rel, a folder that can't be read one with
    its own, besides its row.  With ``any_case`` excluded names match in any case.  With ``follow`` a link to a folder is
    gone into on its own path, unless that folder was gone into before: a set of visited folders, by device and
    inode, ends circles.  Null or repeated roots count once; no roots give no rows.
    """
    spark = roots.sparkSession
    names = frozenset(e.lower() for e in exclude) if any_case else frozenset(exclude)
    place, step = ["dev", "inode"], ["root", "rel", "way"]
    frontier = roots.select("root").filter("root IS NOT NULL").distinct().select("root", F.lit("").alias("rel"), F.col("root").alias("way"))
    visited = None
    levels: list[DataFrame] = []
    while many := frontier.count():
        if len(levels) > DEEPEST:
            raise ValueError(f"a tree is deeper than {DEEPEST} levels")
        dealt = frontier.repartition(min(many // FOLDERS + 1, 10 * spark.sparkContext.defaultParallelism) if many > FOLDERS else 1)
        found = written(_level(dealt, names, globs, any_case), "walk")
        levels.append(found)
        ways = found.filter("kind = 'dir'").select(*step)
        if follow:
            entered = found.filter("kind IN ('dir', 'root')").select(*place)
            visited = entered if visited is None else visited.union(entered)
            # of several links to one folder the least path stands for it
            leads = found.filter("kind = 'link' AND way IS NOT NULL").groupBy(*place).agg(F.min(F.struct(*step)).alias("at")).join(visited.distinct(), place, "left_anti")
            visited = written(visited.union(leads.select(*place)).distinct(), "visited")
            ways = ways.unionByName(written(leads, "leads").select("at.*"))
        frontier = ways
    if not levels:
        return spark.createDataFrame([], ENTRIES).drop("way")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter("kind <> 'root'").drop("way")
