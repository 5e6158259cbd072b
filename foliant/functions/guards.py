"""Column functions that refuse: paths, names, sizes, arguments, sessions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# Archive formats and what a scan's options may be.
FORMATS = ("zip", "tar.gz")
ZIP_MODES, PART_SCOPES = ("auto", "always", "never"), ("pack", "set")


def excluded_by(rel: Column, patterns: list[str]) -> Column:
    """The first glob that fits the whole path, its last part or any part; null without one."""
    parts = F.concat(F.array(rel), F.split(rel, "/"))

    def fits(pattern: str) -> Column:
        regex = fnmatch.translate(pattern.replace("\\", "/").strip()).removesuffix(r"\Z").removesuffix(r"\z")
        return F.exists(parts, lambda p: p.rlike(f"^{regex}$"))

    cases = [F.when(fits(p), F.lit(p)) for p in patterns if p.strip()]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def escapes(rel: Column, links: Column) -> Column:
    """Whether a member leaves its target: by ``..`` or through one of ``links`` (array of paths that are links)."""
    parts = F.split(rel, "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["least"], acc["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least"),
        ),
        lambda acc: acc["least"],
    )
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return rel.startswith("/") | (depth < 0) | F.arrays_overlap(heads, links)


def is_absolute(path: Column) -> Column:
    """Drive, share or root paths."""
    return F.coalesce(path.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|//|/)"), F.lit(False))


def archive_format(name: Column, explicit: Column) -> Column:
    """zip or tar.gz: what is asked for, else what the name says; null for any other."""
    lower = F.lower(name)
    return F.when(F.coalesce(explicit, F.lit("")) != "", F.when(explicit.isin(*FORMATS), explicit)).when(lower.rlike(r"\.(tar\.gz|tgz)$"), "tar.gz").when(lower.endswith(".zip"), "zip")


def safe_segment(value: Column) -> Column:
    """Whether a value is one path part: no separators, illegal or control letters, no dots alone, no dot or space at the end."""
    return F.coalesce((value != "") & ~value.isin(".", "..") & ~value.rlike(paths.ILLEGAL) & ~value.rlike("[. ]$"), F.lit(False))


def subbin_name(name: Column) -> Column:
    """Whether a sub-bin may have this name."""
    return F.coalesce((F.trim(name) == name) & (name != "") & ~name.isin(".", "..") & (F.lower(name) != ".git") & ~name.rlike(r"[\\/:]"), F.lit(False))


def local_model(url: Column) -> Column:
    """Whether a model's address is this machine's."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return host.isin("127.0.0.1", "localhost", "[::1]")


def model_name(name: Column, blocked: tuple[str, ...] = ()) -> Column:
    lower = F.lower(F.coalesce(name, F.lit("")))
    out = (F.trim(lower) != "") & ~lower.rlike(r"[\r\n]")
    for part in blocked:
        out = out & ~lower.contains(part)
    return out


def may_write(dest: Column, roots: list[str], protected: list[str]) -> Column:
    """Inside a root and in no protected folder."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | paths.is_under(dest, F.lit(root))
    for path in protected:
        inside = inside & ~paths.is_under(dest, F.lit(path))
    return inside


def staging_refusal(path: Column, library: str, examples: str) -> Column:
    """Why a staging root or target is refused, or null: under .git, inside the library, among the examples."""
    return (
        F.when(paths.in_folder_named(path, ".git"), "under .git").when(paths.is_under(path, F.lit(library)), "inside the library").when(paths.is_under(path, F.lit(examples)), "among the examples")
    )


def scan_argument_error(min_mb: Column, min_mp: Column, max_dim: Column, quality: Column, min_score: Column, suffix: Column) -> Column:
    """The first option of a scan that is out of range, or null."""
    return (
        F.when((min_mb < 0) | (min_mp < 0), "thresholds").when(max_dim < 1, "max_dim").when(~quality.between(1, 100), "quality")
        .when((F.coalesce(suffix, F.lit("")) == "") | suffix.rlike(r"[\\/]"), "suffix").when(~min_score.between(0, 1), "min_score")
    )


def session_error(kind: Column, status: Column, expected: Column, value: Column, needs_value: Column) -> Column:
    """challenge, auth, rate or null (fine) of a session's check: the response's kind, then its status, then the value it must have."""
    return (
        F.when(kind.isin("challenge", "verification"), "challenge").when((kind == "auth") | status.isin(401, 403), "auth").when((kind == "rate") | (status == 429), "rate")
        .when(status != F.coalesce(expected, F.lit(200)), "auth").when(needs_value & (F.coalesce(value, F.lit("")) == ""), "auth")
    )


def peak_order(score: Column, margin: Column, min_margin: float) -> Column:
    """Greatest first: a peak that stands clear of the second beats any that does not; then the score."""
    return F.struct((margin >= min_margin).alias("clear"), score.alias("score"))


def site_error(known: Column, enabled: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "unknown site").when(~F.coalesce(enabled, F.lit(False)), "site is disabled")


def outputs_present(status: Column, proxy_there: Column, zip_needed: Column, zip_there: Column, verified: Column, recycled: Column) -> Column:
    """Whether a done entry needs no work: its stand-in is there and, if it needs one, its verified archive, and the original is gone."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(status == "done") & flag(proxy_there) & (~flag(zip_needed) | (flag(zip_there) & flag(verified) & flag(recycled)))


def scannable(name: Column, suffixes: tuple[str, ...], proxy_suffix: str) -> Column:
    """An image that is no stand-in."""
    return F.lower(paths.suffix(name)).isin(*suffixes) & ~F.lower(paths.stem(name)).endswith(proxy_suffix.lower())
