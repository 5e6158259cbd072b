"""Inventories between runs: what is read again, what stays known, what went."""

import hashlib
import os

from pyspark.sql import functions as F

from foliant.operators import inventory
from foliant.sources import walk


def sha(data):
    return hashlib.sha256(data).hexdigest()


def scanned(kept, version=None):
    return {r.rel: (r.source, r.sha256, r.error and r.error.split(":")[0]) for r in kept.read(version).collect()}


def test_second_run_reads_what_changed(spark, tmp_path):
    top = tmp_path / "t"
    top.mkdir()
    body = {"a": b"same body!", "b": b"same body!", "c": b"other body", "d": b"lonely", "e": b"", "f": b"", "g": b"same start 1", "h": b"same start 2"}
    for name, data in body.items():
        (top / name).write_bytes(data)
    os.link(top / "a", top / "link")
    roots = spark.createDataFrame([(str(top),)], "root string")
    kept = inventory.Inventory(spark, str(tmp_path / "kept"))
    assert kept.read().count() == 0
    first = kept.record(walk.walk(roots))
    kept.scan(prefix_bytes=4)
    got = scanned(kept)
    assert {n: s for n, (s, _, _) in got.items()} == {"a": "read", "b": "read", "link": "read", "c": None, "d": None, "e": "empty", "f": "empty", "g": "read", "h": "read"}
    assert all(got[n][1] == sha(body[n]) for n in "abgh") and got["c"][1] is None  # c has the size, not the beginning
    (top / "b").unlink()
    (top / "c").write_bytes(b"same body!")
    os.rename(top / "g", top / "moved")
    (top / "new").write_bytes(b"same start 3")
    second = kept.record(walk.walk(roots))
    kept.scan(prefix_bytes=4)
    again = scanned(kept)
    # what is known is not read again, also under another name; what is new or changed is
    assert {n: s for n, (s, _, _) in again.items()} == {"a": "cache", "link": "cache", "c": "read", "d": None, "e": "empty", "f": "empty", "moved": "cache", "h": "cache", "new": "read"}
    assert again["c"][1] == sha(b"same body!") and again["moved"][1] == sha(body["g"])
    only = lambda v: kept.read(v).select("root", "rel", *inventory.KEY)
    change = {r.rel: r.change for r in inventory.changes(only(first), only(second)).collect()}
    assert change == {"a": "same", "link": "same", "b": "gone", "c": "changed", "d": "same", "e": "same", "f": "same", "g": "gone", "moved": "moved", "h": "same", "new": "added"}


def test_unreadable_files_and_no_inodes(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"12345")
    rows = [(str(tmp_path), "x", 5, 1.0, None, None), (str(tmp_path), "gone", 5, 1.0, None, None), (str(tmp_path), "gone2", 5, None, 0, 0), (str(tmp_path), "odd", None, None, None, None)]
    files = spark.createDataFrame(rows, inventory.FILES)
    none = spark.createDataFrame([], inventory.CACHE)
    got = {r.rel: (r.source, r.error and r.error.split(":")[0]) for r in inventory.deep_scan(files, none).collect()}
    # without inode numbers the path tells files apart
    assert got == {"x": (None, None), "gone": (None, "FileNotFoundError"), "gone2": (None, "FileNotFoundError"), "odd": (None, None)}
    known = spark.createDataFrame([(None, None, 5, 1.0, f"{tmp_path}/gone", "p", "s")], inventory.CACHE)
    assert {r.rel: r.source for r in inventory.deep_scan(files, known).filter(F.col("rel") == "gone").collect()} == {"gone": "cache"}
    assert inventory.deep_scan(files.limit(0), none).count() == 0
