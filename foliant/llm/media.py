"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A text's bytes, padded to whole rows of 64, become an 8-bit greyscale PNG image (lossless).  Each task
appends the images it has not yet written to a tar shard in the shared folder, under the digest of the
payload; rows keep shard, offset and length.  Equal payloads have equal bytes wherever they lie, and the
manifest points all rows of a digest in a shard to one copy, so copies cost a row and not their bytes.

The manifest is a written table: a task that is repeated writes a shard of another name, and only shards
that the manifest names count.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_path, written
from .files import resolve

#: Samples of a row of the image.
WIDTH = 64
#: A task begins another shard beyond this size.
SHARD_BYTES = 256 << 20
#: Stored bytes that one task of the reading pass handles.
READ_BYTES = 12 << 20
#: Fixed value: the first eight bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: From the start of a member to its last header byte: tar header, signature and the IHDR chunk.
HEADER = 512 + 8 + 25


def padded(data: bytes) -> bytes:
    """The data with zero bytes up to a positive multiple of the row width."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def to_png(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # every row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = WIDTH.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes of an image."""
    if header[:8] != SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return int.from_bytes(header[16:20], "big"), int.from_bytes(header[20:24], "big"), header[24]


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; checks of the chunks guard against damage."""
    width, height, _ = png_size(data)
    at, body = 8, b""
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body += part
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


class _Shard:
    """A tar file that is being written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.tar"
        system, name = resolve(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out, self.size, self.known = system.open_output_stream(name), 0, {}

    def add(self, digest: str, make) -> tuple[int, int]:
        if (place := self.known.get(digest)) is None:
            data = make()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            member = info.tobuf(tarfile.USTAR_FORMAT) + data
            self.out.write(member + bytes(-len(member) % 512))
            place = self.known[digest] = (self.size, len(data))
            self.size += len(member) + -len(member) % 512
        return place

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest: id, digest (of the payload), n_bytes, shard, offset (of the tar member) and length (of the image).

    Null texts are stored as empty ones (64 zero bytes).
    """
    folder = new_path(docs.sparkSession, "media")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shard = None
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("digest", "n_bytes", "shard", "offset", "length")}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                payload = padded(text or b"")
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.size > SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = _Shard(folder)
                offset, length = shard.add(digest, lambda payload=payload: to_png(payload))
                for k, v in zip(rows, (digest, len(text or b""), shard.path, offset, length)):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), **rows})
        if shard:
            shard.close()

    made = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, digest string, n_bytes bigint, shard string, offset bigint, length bigint")
    return written(made, "manifest")


@lru_cache(maxsize=8)
def _opened(path: str):
    system, name = resolve(path)
    return system.open_input_file(name)


def read_range(path: str, offset: int, size: int) -> bytes:
    return _opened(path).read_at(size, offset)


def _spread(manifest: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a stretch of a shard together and in order, in tasks of about READ_BYTES."""
    total = manifest.agg(F.sum("length")).first()[0] or 0
    parts = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return manifest.select(*columns).repartition(parts, "shard", F.floor(F.col("offset") / F.lit(READ_BYTES // 4))).sortWithinPartitions("shard", "offset")


def header_columns(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, width, height and bit_depth of each row from its image's header alone: one small range read, no payload."""

    def make():
        def step(batch: pa.RecordBatch):
            sizes = [png_size(read_range(p, o, HEADER)[512:]) for p, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield {id_col: batch.column(0), **{k: [s[n] for s in sizes] for n, k in enumerate(("width", "height", "bit_depth"))}}

        return step

    return map_arrow(_spread(manifest, (id_col, "shard", "offset")), make, f"`{id_col}` {manifest.schema[id_col].dataType.simpleString()}, width int, height int, bit_depth int")


def _features(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 difference hash of the image, as text; integers only, so equal everywhere."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, squares = int(samples.sum()), int((samples * samples).sum())
    rows = samples.reshape(-1, WIDTH)
    bands = [b.sum(0) if len(b) else np.zeros(WIDTH, np.int64) for b in np.array_split(rows, 8)]
    cells = np.array([[int(b[i * 7 : i * 7 + 8].sum()) for i in range(9)] for b in bands])
    bits = "".join("1" if x < y else "0" for r in cells for x, y in zip(r, r[1:]))
    n = len(samples)
    return f"mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};dhash={int(bits, 2):016x}"


def read_back(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes say, one row for each row of the manifest: see ``media_columns``."""

    def make():
        last: tuple[tuple[str, int], tuple] | None = None

        def read(place: tuple[str, int], length: int, digest: str) -> tuple:
            nonlocal last
            if last is None or last[0] != place:  # copies follow one another
                width, height, depth = png_size(read_range(*place, HEADER)[512:])  # the metadata columns: header bytes only
                media = read_range(place[0], place[1] + 512, length)
                payload = from_png(media)
                if (sha := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"{place}: the stored payload is not the one its name says")
                last = (place, (len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), _features(payload), width, height, depth))
            return last[1]

        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")

        def step(batch: pa.RecordBatch):
            rows = [read((p, o), n, d) for p, o, n, d in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)])]
            yield {id_col: batch.column(0), "n_bytes": batch.column(1), **{k: [r[n] for r in rows] for n, k in enumerate(names)}}

        return step

    kind = manifest.schema[id_col].dataType.simpleString()
    spread = _spread(manifest, (id_col, "n_bytes", "shard", "offset", "length", "digest"))
    return map_arrow(spread, make, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, bit_depth int")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, bit_depth.

    Every text is stored and its stored bytes are read again, whole, whatever its length; width, height and bit depth come
    from range reads of the headers alone.  Null texts count
    as empty.  Repeated rows and null ids come back as they came; an empty table gives an empty result;
    other columns are not read.
    """
    return read_back(store(docs, id_col=id_col, text_col=text_col), id_col=id_col)
