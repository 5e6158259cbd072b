"""Column functions over POSIX-style paths and file names."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that only say when files were dumped, and characters no file name may have.
DATE_FOLDER = r"^(?:\d{4}|\d{4}[-_]\d{2}|\d{4}[-_]\d{2}[-_]\d{2}|\d{8})$"
YEAR_FOLDER = r"^\d{4}$"
MONTH_FOLDER = r"^(?:0[1-9]|1[0-2])$"
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last dot part with its dot; empty for dot files and names that end in a dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def join_path(*parts: Column) -> Column:
    """Parts with single slashes between them; empty parts vanish."""
    return F.regexp_replace(F.concat_ws("/", *[F.when(p != "", p) for p in parts]), "/+", "/")


def bundle_and_pack(relpath: Column) -> Column:
    """struct<bundle, pack, rest>: the first two folders that are not dates, and the path below them.

    A bare month is a date right after a bare year.  Missing ones are ``_unknown`` and ``_root``.
    """
    parts = F.split(relpath, "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin("", ".", ".."))
    after_year = lambda i: F.coalesce(F.get(folders, i - 1).rlike(YEAR_FOLDER), F.lit(False))
    kept = F.filter(folders, lambda p, i: ~(p.rlike(DATE_FOLDER) | (after_year(i) & p.rlike(MONTH_FOLDER))))
    name = F.element_at(parts, -1)
    rest = F.when(F.size(kept) > 2, F.concat_ws("/", F.array_join(F.slice(kept, 3, F.greatest(F.size(kept) - 2, F.lit(0))), "/"), name)).otherwise(name)
    return F.struct(F.coalesce(F.get(kept, F.lit(0)), F.lit("_unknown")).alias("bundle"), F.coalesce(F.get(kept, F.lit(1)), F.lit("_root")).alias("pack"), rest.alias("rest"))


def is_under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or lies below it; ``/a/bc`` is not under ``/a/b``."""
    path, root = F.lower(posix(path)), F.rtrim(F.lower(posix(root)), F.lit("/"))
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def in_folder_named(path: Column, name: str) -> Column:
    """Whether some component has this name, in any case."""
    return F.exists(F.split(posix(path), "/"), lambda p: F.lower(p) == name)


def render(template: str, tokens: dict[str, Column]) -> Column:
    """The template's text with its known ``{tokens}`` in place; unknown ones stay as they are written."""
    parts: list[Column] = []
    for text, token, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if token is not None:
            parts.append(F.coalesce(tokens[token], F.lit("")) if token in tokens else F.lit("{" + token + "}"))
    return F.concat(*parts)


def with_marked_stem(path: Column, mark: Column) -> Column:
    """``dir/stem<mark>.ext``"""
    name = file_name(path)
    return F.concat(F.left(path, F.length(path) - F.length(name)), stem(name), mark, suffix(name))


def archive_member_reason(name: Column) -> Column:
    """Why an archive member's name is unsafe, or null: empty, nul, absolute, drive, traversal, illegal character."""
    plain = posix(name)
    return (
        F.when(F.coalesce(plain, F.lit("")) == "", "empty")
        .when(F.instr(plain, "\x00") > 0, "nul")
        .when(plain.startswith("/"), "absolute")
        .when(plain.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(F.split(plain, "/"), lambda p: p == ".."), "traversal")
        .when(plain.rlike(r'[<>:"|?*\x00-\x1f]'), "illegal")
    )


def canonical_member(name: Column) -> Column:
    """Without ``.`` components and doubled slashes."""
    return F.array_join(F.filter(F.split(posix(name), "/"), lambda p: ~p.isin("", ".")), "/")


def sanitized(name: Column, fallback: str = "item", limit: int = 80) -> Column:
    """A name usable as one path component."""
    clean = F.regexp_replace(F.left(F.regexp_replace(F.trim(name), ILLEGAL, "_"), F.lit(limit)), "[ .]+$", "")
    safe = F.when(F.upper(F.split(clean, r"\.")[0]).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(safe == "", fallback).otherwise(safe)


def human_bytes(n: Column) -> Column:
    """1024-based with one decimal; plain bytes below 1024."""
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def set_directory(path: Column, levels: int) -> Column:
    """The ancestor folder at a fixed depth below the root."""
    folders = F.split(parent(path), "/")
    return F.array_join(F.slice(folders, 1, levels), "/")


def zip_archive_name(name: Column, image_suffixes: tuple[str, ...]) -> Column:
    """Base name of the archive of an image: its image suffix off, white space to single underscores."""
    bare = F.when(F.lower(suffix(name)).isin(*image_suffixes), stem(name)).otherwise(name)
    return F.concat(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", "_"), "_+", "_"), F.lit("_")), F.lit(".zip"))
