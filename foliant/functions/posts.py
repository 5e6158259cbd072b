"""Column functions over posts, their files and their links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# File types that count as downloads, image types, and the suffix of each media type.
FILE_TYPES = (".zip", ".rar", ".7z", ".pdf", ".psd", ".uvtt", ".mp3", ".wav", ".mp4", ".mov", ".blend")
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".gif", ".webp")
MIME_TYPES = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp",
    "application/zip": ".zip", "application/x-zip-compressed": ".zip", "application/pdf": ".pdf", "audio/mpeg": ".mp3", "audio/mp3": ".mp3",
    "audio/wav": ".wav", "audio/x-wav": ".wav", "video/mp4": ".mp4", "video/quicktime": ".mov",
}
#: Path parts before and after a creator's name.
CREATOR_PREFIXES, IGNORED_TAILS = ("c", "cw", "user"), ("posts", "about", "home", "membership", "shop")
FILE_KINDS = ("zip", "loose-media", "other")
FILE_STATUSES = ("planned", "downloaded", "failed", "skipped-duplicate", "skipped", "deferred", "locked", "excluded")


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def name_extension(name: Column) -> Column:
    """Lower-case suffix of one to seven letters or digits, dot included; empty for dot files and others."""
    return F.regexp_extract(F.lower(paths.file_name(_text(name))), r"^.+?(\.[a-z0-9]{1,7})$", 1)


def url_tail(url: Column) -> Column:
    """The last path part of an address, without query, fragment and closing slashes."""
    path = F.regexp_replace(F.regexp_replace(_text(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return paths.file_name(F.rtrim(path, F.lit("/")))


def mime_extension(mime: Column) -> Column:
    bare = F.lower(F.trim(F.split(_text(mime), ";")[0]))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair]), bare), F.lit(""))


def with_extension(name: Column, url: Column, mime: Column, fallback: str = "file") -> Column:
    """A name with a suffix: its own, else the address's, else the media type's; without a name the address's tail."""
    own = F.trim(_text(name))
    base = F.when(own != "", own).when(url_tail(url) != "", url_tail(url)).otherwise(fallback)
    extra = F.coalesce(F.nullif(name_extension(url_tail(url)), F.lit("")), mime_extension(mime))
    return F.when((name_extension(base) != "") | F.lower(base).endswith(extra), base).otherwise(F.concat(base, extra))


def looks_like_image(name: Column, mime: Column, url: Column) -> Column:
    return F.lower(_text(mime)).startswith("image/") | name_extension(name).isin(*IMAGE_TYPES) | name_extension(url_tail(url)).isin(*IMAGE_TYPES)


def downloadable(name: Column, mime: Column, url: Column) -> Column:
    """A file that is no image, has an address and is of a known type."""
    kind = F.coalesce(F.nullif(name_extension(name), F.lit("")), F.nullif(name_extension(url_tail(url)), F.lit("")), mime_extension(mime))
    return (_text(url) != "") & ~looks_like_image(name, mime, url) & kind.isin(*FILE_TYPES)


def creator_of(url: Column) -> Column:
    """The creator's name in an address; empty without one."""
    path = F.regexp_replace(F.regexp_replace(_text(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)).isin(*CREATOR_PREFIXES), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    parts = F.when(F.get(parts, F.size(parts) - 1).isin(*IGNORED_TAILS), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return _text(F.get(parts, F.size(parts) - 1))


def folder_safe(slug: Column) -> Column:
    """Whether a slug can be a folder's name as it is."""
    return F.coalesce(slug.rlike(r"^[A-Za-z0-9][A-Za-z0-9._ -]*$") & ~F.upper(slug).isin(*paths.RESERVED) & ~slug.rlike("[. ]$"), F.lit(False))


def post_folder(post_id: Column, title: Column, limit: int = 90) -> Column:
    """``id_title`` of sanitized parts, at most ``limit`` letters; the id alone if nothing else is left."""
    own = paths.sanitized(post_id, "post", 40)
    clean = paths.sanitized(_text(title), "", 80)
    name = F.concat(own, F.lit("_"), F.when(clean == "", own).otherwise(clean))
    cut = F.regexp_replace(F.left(name, F.lit(limit)), "[ .]+$", "")
    return F.when(F.length(name) <= limit, name).when(cut == "", own).otherwise(cut)


def summary_line(slug: Column, accessible: Column, locked: Column, excluded: Column, deferred: Column, listed: Column) -> Column:
    """Fixed text: one line for a creator's listing."""
    return (
        F.when(listed == 0, F.concat(slug, F.lit(": 0 posts in window")))
        .when((accessible == 0) & (locked == listed), F.format_string("%s: 0 accessible posts in window (%d listed, %d locked for your tier)", slug, listed, locked))
        .otherwise(F.format_string("%s: %d accessible, %d locked, %d excluded, %d deferred (%d listed)", slug, accessible, locked, excluded, deferred, listed))
    )


def too_big(size: Column, max_mb: Column) -> Column:
    """Whether a size is over the cap; unknown sizes and no cap are not."""
    return F.coalesce(size > max_mb * 1024 * 1024, F.lit(False))


def before_day(published: Column, zone: str, day: Column) -> Column:
    """Whether a post lies before a local day (yyyy-MM-dd); without a day, or a wrong one, nothing does."""
    return F.coalesce(F.from_utc_timestamp(published, zone) < F.try_to_timestamp(F.left(day, F.lit(10)), F.lit("yyyy-MM-dd")), F.lit(False))


def kind_or_other(kind: Column) -> Column:
    return F.when(kind.isin(*FILE_KINDS), kind).otherwise("other")


def status_or_failed(status: Column) -> Column:
    return F.when(status.isin(*FILE_STATUSES), status).otherwise("failed")


def content_name(name: Column, digest: Column, plain_taken: Column, short_taken: Column) -> Column:
    """A free name for new content: itself, then with 8 digits of the digest, then with 16."""
    marked = lambda n: F.concat(paths.stem(name), F.lit("__"), F.left(digest, F.lit(n)), paths.suffix(name))
    return F.when(~plain_taken, name).when(~short_taken, marked(8)).otherwise(marked(16))


def cookie_header(raw: Column) -> Column:
    """struct<header, bare>: white space, quotes and a ``Cookie:`` prefix off; a bare value becomes the session's; null header for line breaks."""
    text = F.trim(_text(raw))
    quoted = (F.length(text) >= 2) & text.rlike("""^(["']).*\\1$""")
    text = F.when(quoted, F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    text = F.when(F.lower(text).startswith("cookie:"), F.trim(F.substring(text, 8, 1 << 20))).otherwise(text)
    bare = (text != "") & ~text.contains("=")
    header = F.when(text.rlike(r"[\r\n]"), F.lit(None)).when(bare, F.concat(F.lit("session_id="), text)).otherwise(text)
    return F.struct(header.alias("header"), bare.alias("bare"))


def without_secret(text: Column, secret: Column) -> Column:
    return F.when(_text(secret) == "", text).otherwise(F.replace(text, secret, F.lit("<redacted>")))


def snippet(text: Column, limit: int = 200) -> Column:
    return F.left(F.translate(_text(text), "\r\n", "  "), F.lit(limit))
