"""Archive members, listed without unpacking, and image headers."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Largest inner archive that is opened, and levels below the outermost.
NESTED_BYTES, NESTED_DEPTH = 50 << 20, 2
ENTRIES = "path string, parent string, depth int, inner_path string, size bigint, crc32 bigint, error string"
MEMBERS = "path string, name string, size bigint, sha256 string, reason string, ord int"
DIMENSIONS = "path string, width int, height int, kind string"


def files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("node_modules", ".git", "__MACOSX", ".DS_Store"), content: bool = False) -> DataFrame:
    """path, relpath, mtime, size (and content) of all files below ``root``, without those that have an excluded part.

    Without ``content`` no byte of a file is read.
    """
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), "/+", "/")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.replace(base, F.lit(top), F.lit(""))
    kept = found.withColumn("relpath", rel).filter(~F.exists(F.split(rel, "/"), lambda p: p.isin(*exclude)))
    return kept.select("path", "relpath", F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"), *(["content"] if content else []))


def _listing(path: str, data: bytes, parent: str | None, depth: int, nested: bool) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                name = info.filename.replace("\\", "/")
                yield path, parent, depth, name, info.file_size, info.CRC, None
                if nested and depth < NESTED_DEPTH and name.lower().endswith(".zip") and info.file_size <= NESTED_BYTES:
                    with z.open(info) as inner:
                        body = inner.read(NESTED_BYTES + 1)  # whatever size the archive declares
                    if len(body) <= NESTED_BYTES:
                        yield from _listing(f"{path}!{name}", body, path, depth + 1, nested)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as problem:
        yield path, parent, depth, None, None, None, f"{type(problem).__name__}: {problem}"


def zip_entries(blobs: DataFrame, nested: bool = True) -> DataFrame:
    """One row for each member of zip files (path, content), inner zips too; a damaged one gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = list(_listing(path, data, None, 0, nested))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "parent", "depth", "inner_path", "size", "crc32", "error"]).astype({"size": "Int64", "crc32": "Int64"})

    return blobs.select("path", "content").mapInPandas(run, ENTRIES)


def members(path: str, data: bytes) -> Iterator[tuple]:
    """(path, name, size, sha256, reason, order) of each member of a zip or tar.gz file; a damaged one gives a row with the error as its reason."""
    try:
        yield from _tar_members(path, data) if data[:2] == b"\x1f\x8b" else _zip_members(path, data)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, NotImplementedError, RuntimeError, zlib.error) as problem:
        yield path, None, None, None, f"unreadable: {type(problem).__name__}", -1


def _tar_members(path: str, data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
        for n, m in enumerate(t.getmembers()):
            kinds = ((m.issym(), "symlink"), (m.islnk(), "hardlink"), (m.isfifo(), "fifo"), (m.ischr() or m.isblk(), "device"))
            reason = next((why for bad, why in kinds if bad), None)
            if m.isdir():
                continue
            body = t.extractfile(m).read() if reason is None else b""
            yield path, m.name, m.size, hashlib.sha256(body).hexdigest() if reason is None else None, reason, n


def _zip_members(path: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n, m in enumerate(z.infolist()):
            if m.is_dir():
                continue
            mode = m.external_attr >> 16 & 0o170000
            reason = "symlink" if mode == 0o120000 else "special" if mode not in (0, 0o100000) else None
            body = z.read(m) if reason is None else b""
            yield path, m.filename, m.file_size, hashlib.sha256(body).hexdigest() if reason is None else None, reason, n


def reader(data: bytes):
    """A function from a member's name to its bytes."""
    if data[:2] == b"\x1f\x8b":
        t = tarfile.open(fileobj=io.BytesIO(data), mode="r:gz")
        return lambda name: t.extractfile(name).read()
    z = zipfile.ZipFile(io.BytesIO(data))
    return z.read


def archive_members(blobs: DataFrame) -> DataFrame:
    """name, size, sha256, reason (links, devices, damage) and order of zip and tar.gz members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = list(members(path, bytes(data)))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "name", "size", "sha256", "reason", "ord"]).astype({"size": "Int64"})

    return blobs.select("path", "content").mapInPandas(run, MEMBERS)


def mark_repeats(members: DataFrame) -> DataFrame:
    """``reason`` is ``duplicate`` for all but the first member of a name (in any case)."""
    from pyspark.sql import functions as F

    first = members.filter("reason IS NULL").groupBy("path", F.lower("name").alias("_k")).agg(F.min("ord").alias("_first"))
    own = members.withColumn("_k", F.lower("name")).join(first, ["path", "_k"], "left")
    return own.withColumn("reason", F.coalesce("reason", F.when(F.col("ord") > F.col("_first"), "duplicate"))).drop("_k", "_first")


def _size(data: bytes) -> tuple[int | None, int | None, str | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return (*struct.unpack(">II", data[16:24]), "png")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return (*struct.unpack("<HH", data[6:10]), "gif")
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), "bmp"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, "jpeg"
            at += 2 + length
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        return _webp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    return None, None, None


def _webp(data: bytes) -> tuple[int | None, int | None, str | None]:
    kind = data[12:16]
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "webp"
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "webp"
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF, "webp"
    return None, None, None


def _tiff(data: bytes) -> tuple[int | None, int | None, str | None]:
    """Width and height (tags 256 and 257) of the first directory."""
    order = "little" if data[:2] == b"II" else "big"
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    at = number(4, 4)
    found = {}
    for k in range(number(at, 2)):
        entry = at + 2 + 12 * k
        if (tag := number(entry, 2)) in (256, 257):
            found[tag] = number(entry + 8, 2 if number(entry + 2, 2) == 3 else 4)
    return (found[256], found[257], "tiff") if len(found) == 2 else (None, None, None)


def dimensions(blobs: DataFrame) -> DataFrame:
    """width, height and kind of images from their headers; null for anything else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *_size(bytes(d))) for p, d in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "kind"]).astype({"width": "Int32", "height": "Int32"})

    return blobs.select("path", "content").mapInPandas(run, DIMENSIONS)
