import hashlib
import io
import threading
import zipfile

import numpy as np
import pytest

from foliant.operators import effects, locate, packing
from foliant.sources import archives


def test_json_never_overwrites(tmp_path):
    path = str(tmp_path / "a" / "x.json")
    assert effects.write_json(path, {"b": 1}) == "written" and effects.write_json(path, {"b": 1}) == "unchanged"
    with pytest.raises(effects.Refused):
        effects.write_json(path, {"b": 2})
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]


def test_register_keeps_one_generation(tmp_path):
    path = str(tmp_path / "r.json")
    errors = lambda d: [] if "entries" in d else ["no entries"]
    effects.save_register(path, {"entries": [1]}, errors)
    effects.save_register(path, {"entries": [1, 2]}, errors)
    with pytest.raises(effects.Refused):
        effects.save_register(path, {}, errors)
    assert '"entries"' in open(path + ".prev").read() and "2" in open(path).read() and "2" not in open(path + ".prev").read()
    seen = []

    def act(entry):
        seen.append(entry["id"])
        if entry["id"] == 3:
            raise RuntimeError("stop")
        return {"status": "done"}

    register = {"entries": [{"id": 1, "status": "done"}, {"id": 2}, {"id": 3}, {"id": 4}]}
    with pytest.raises(RuntimeError):
        effects.apply_entries(path, register, act, errors)
    assert seen == [2, 3] and '"id": 2,\n      "status": "done"' in open(path).read()


def test_copy_waits_for_locks(tmp_path):
    (tmp_path / "a").write_text("data")
    waits, tries = [], []

    def locked(src, file):
        tries.append(1)
        if len(tries) < 4:
            raise PermissionError("locked")
        file.write(open(src, "rb").read())

    undo = []
    effects.copy_verified(str(tmp_path / "a"), str(tmp_path / "b"), undo=undo, sleep=waits.append, copy=locked)
    assert waits == [1, 2, 4] and undo[0]["action"] == "COPY" and undo[0]["sha256"] == hashlib.sha256(b"data").hexdigest().upper()
    with pytest.raises(effects.Refused):
        effects.copy_verified(str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(effects.Refused):
        effects.copy_verified(str(tmp_path / "a"), str(tmp_path / "c"), copy=lambda s, f: f.write(b"other"))
    with pytest.raises(PermissionError):
        effects.copy_verified(str(tmp_path / "a"), str(tmp_path / "d"), sleep=waits.append, copy=lambda s, f: (_ for _ in ()).throw(PermissionError()))
    assert waits[3:] == [1, 2, 4, 8, 16] and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_streams_parts_and_stored_archives(tmp_path):
    at = lambda n: str(tmp_path / n)
    assert effects.write_stream(at("x"), [b"ab", b"c"], 3) == 3
    with pytest.raises(effects.Refused):
        effects.write_stream(at("y"), [b"ab"], 3)
    effects.write_stream(at("p1"), [b"one"])
    effects.write_stream(at("p2"), [b"two"])
    assert effects.reassemble([at("p1"), at("p2")], at("whole")) == 6 and open(at("whole")).read() == "onetwo"
    with pytest.raises(effects.Refused):
        effects.reassemble([at("p1")], at("z"))
    sha = effects.zip_original(at("whole"), at("whole.zip"))
    effects.verify_zip(at("whole.zip"), "whole", sha)
    with pytest.raises(effects.Refused):
        effects.verify_zip(at("whole.zip"), "whole", "0" * 64)


def test_actions_undo_and_backups(tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    gone = []
    plan = [{"op": "mkdir", "dst": at("d")}, {"op": "copy", "src": at("a"), "dst": at("d/a")}, {"op": "move", "src": at("b"), "dst": at("d/b")}, {"op": "copy", "src": at("none"), "dst": at("d/n")}, {"op": "recycle", "src": at("a")}]
    out = effects.run_actions(plan, gone.append, stop_on_error=True)
    assert [r["status"] for r in out] == ["ok", "ok", "ok", "failed", "skipped"] and gone == []
    out = effects.run_actions(plan[4:] + [{"op": "copy", "src": at("a"), "dst": at("d/a")}, {"op": "recycle", "src": at("d/b"), "sha256": "0" * 64}], gone.append)
    assert [(r["status"], r["reason"]) for r in out] == [("ok", ""), ("failed", "destination exists"), ("failed", "sha256 differs")] and gone == [at("a")]
    effects.append_undo(at("undo.csv"), [effects.undo_row("move", "x", "y", 1, "ab")])
    effects.append_undo(at("undo.csv"), [effects.undo_row("copy", "x", "z", None, None)])
    lines = open(at("undo.csv"), encoding="utf-8-sig").read().splitlines()
    assert lines[0] == "action,source,destination,size,sha256,timestamp" and lines[1].startswith("MOVE,x,y,1,AB,") and len(lines) == 3
    first = effects.backup(at("d/a"))
    (tmp_path / "d/a").write_text("a")
    assert effects.backup(at("d/a")) == first[:-4] + ".2.bak"


def test_reports_bounded_runs_and_jobs(tmp_path):
    job = tmp_path / "job"
    job.mkdir()
    (job / "a.txt").write_text("x")
    (job / "b.bin").write_text("x")
    (job / "c.log").write_bytes(bytes(2 << 20))
    assert effects.copy_reports(str(job), str(tmp_path / "out")) == ["a.txt"]
    now, sleeps = [0.0], []

    def sleep(s):
        sleeps.append(s)
        now[0] += s

    assert effects.run_bounded(lambda x: x * 2, [3, 1, 2], workers=9, spacing=1.0, clock=lambda: now[0], sleep=sleep) == [6, 2, 4] and sleeps == [1.0, 1.0]
    jobs, hold = effects.Jobs(3), threading.Event()

    def work(say):
        for n in range(9):
            say(n)
        hold.wait(5)
        return "ok"

    one = jobs.start("scan", work)
    with pytest.raises(effects.Refused):
        jobs.start("other", work)
    hold.set()
    one["thread"].join(5)
    assert (one["state"], one["result"], list(one["log"])) == ("done", "ok", [6, 7, 8])
    two = jobs.start("bad", lambda say: 1 / 0)
    two["thread"].join(5)
    assert two["state"] == "failed" and effects.final_line(1, 2, 3) == "FINAL ok=1 skipped=2 failed=3"
    assert effects.log_event("info", "copy", "/a", size=1) == '{"action": "copy", "level": "info", "path": "/a", "size": 1}'


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_pack_and_unpack(spark, tmp_path, kind):
    files = spark.createDataFrame([("p", "a/x.txt", bytearray(b"one")), ("p", "b.txt", bytearray(b"two")), ("q", "c", bytearray(b""))], "archive string, rel string, content binary")
    blobs = packing.packed(files, kind)
    assert {(r.archive, r.members, r.bytes) for r in blobs.collect()} == {("p", 2, 6), ("q", 1, 0)}
    blobs = blobs.select(F_path(), "content")
    members = archives.archive_members(blobs)
    none = spark.createDataFrame([], "rel string, kind string, size bigint, sha256 string")
    actions = packing.member_actions(members, none)
    assert {r.action for r in actions.collect()} == {"new"}
    target = str(tmp_path / "t")
    assert {r.result for r in packing.extract(blobs, actions, target).collect()} == {"would write (new)"} and not (tmp_path / "t").exists()
    assert {r.result for r in packing.extract(blobs, actions, target, dry_run=False).collect()} == {"written"}
    assert (tmp_path / "t/a/x.txt").read_text() == "one" and (tmp_path / "t/c").read_text() == ""
    assert {r.result for r in packing.extract(blobs, actions, target, dry_run=False).collect()} == {"unchanged"}
    (tmp_path / "t/b.txt").write_text("changed")
    there = spark.createDataFrame([("b.txt", "file", 7, effects.digest(str(tmp_path / "t/b.txt"))), ("a", "link", None, None)], "rel string, kind string, size bigint, sha256 string")
    judged = packing.member_actions(members, there, "backup")
    assert {r.name: (r.action, r.reason) for r in judged.collect()} == {"a/x.txt": ("unsafe", "escapes"), "b.txt": ("conflict-backup", None), "c": ("new", None)}
    packing.extract(blobs, judged, target, dry_run=False).collect()
    assert (tmp_path / "t/b.txt").read_text() == "two" and len(list((tmp_path / "t").glob("b.txt.*.bak"))) == 1
    assert [r.rel for r in packing.extra_files(spark.createDataFrame([("b.txt",), ("z",)], "rel string"), members).collect()] == ["z"]


def F_path():
    from pyspark.sql import functions as F

    return F.col("archive").alias("path")


def test_damaged_and_hostile_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("ok.txt", "OK.txt", "../up", "/abs"):
            z.writestr(name, "x")
    blobs = spark.createDataFrame([("bad.zip", bytearray(b"PK\x03\x04broken")), ("bad.tgz", bytearray(b"\x1f\x8bbroken")), ("a.zip", bytearray(out.getvalue()))], "path string, content binary")
    rows = archives.archive_members(blobs).collect()
    assert {r.path for r in rows if r.reason and r.reason.startswith("unreadable")} == {"bad.zip", "bad.tgz"}
    none = spark.createDataFrame([], "rel string, kind string, size bigint, sha256 string")
    judged = packing.member_actions(archives.archive_members(blobs.filter("path = 'a.zip'")), none)
    assert {r.name: r.reason for r in judged.collect()} == {"ok.txt": None, "OK.txt": "duplicate", "../up": "traversal", "/abs": "absolute"}


def test_parts_are_located(spark):
    draw = np.random.default_rng(1)
    whole = np.kron(draw.integers(0, 255, (24, 32)), np.ones((5, 5))).astype(np.uint8)  # 160 x 120
    cut = {"f": (0, 0), "g": (80, 0), "h": (0, 60)}
    parts = [("s", n, 80, 60, bytearray(whole[y : y + 60, x : x + 80].tobytes())) for n, (x, y) in cut.items()]
    parts.append(("s", "odd", 80, 60, bytearray(draw.integers(0, 255, 4800).astype(np.uint8).tobytes())))
    parts.append(("s", "flat", 80, 60, bytearray(4800)))
    o = spark.createDataFrame([("s", 160, 120, bytearray(whole.tobytes())), ("t", 8, 8, bytearray(64))], "sheet string, width int, height int, pixels binary")
    p = spark.createDataFrame(parts, "sheet string, part string, width int, height int, pixels binary")
    hits = locate.located(o, p)
    rows = {r.part: r for r in hits.collect()}
    for n, (x, y) in cut.items():
        assert (rows[n].x, rows[n].y, rows[n].w, rows[n].h) == (x, y, 80, 60) and rows[n].score > 0.99 and rows[n].margin > 0.05
    assert rows["odd"].score < 0.9 and rows["flat"].score <= 0
    told = {r.sheet: r for r in locate.analysed(o, hits.filter("part IN ('f', 'g', 'h')"), 160, 120).collect()}
    assert (told["s"].parts, told["s"].sure, round(told["s"].coverage, 2), told["s"].confident) == (3, 3, 0.75, False) and not told["t"].confident
    cells = spark.createDataFrame([("s", c, i, x, y, 80, 60) for i, (c, x, y) in enumerate((("f", 0, 0), ("g", 80, 0), ("h", 1, 61), ("i", 80, 60)))], "sheet string, cell string, cell_index int, x int, y int, w int, h int")
    made = locate.recreation(cells, hits.filter("part <> 'odd'")).collect()
    assert [(r.cell, r.sibling) for r in made] == [("i", "h")]
    assert locate.score_at(whole, whole[60:, 80:], 80, 60, 80, 60) > 0.99 > locate.score_at(whole, whole[60:, 80:], 0, 0, 80, 60)


def test_scaled_part_and_wrong_sheet(spark):
    draw = np.random.default_rng(2)
    sheets = {n: np.kron(draw.integers(0, 255, (20, 20)), np.ones((10, 10))).astype(np.uint8) for n in "ab"}
    big = np.kron(sheets["b"][50:150, 20:120], np.ones((2, 2))).astype(np.uint8)  # twice the overview's size
    x, y, w, h, score, _, _ = locate.search(sheets["b"], big, 0.25, 1.0)
    assert abs(x - 20) <= 2 and abs(y - 50) <= 2 and abs(w - 100) <= 3 and score > 0.9
    o = spark.createDataFrame([(n, 200, 200, bytearray(s.tobytes())) for n, s in sheets.items()], "sheet string, width int, height int, pixels binary")
    part = bytearray(sheets["b"][50:150, 20:120].tobytes())
    p = spark.createDataFrame([(n, "m", 100, 100, part) for n in "ab"], "sheet string, part string, width int, height int, pixels binary")
    wrong = locate.misnamed(locate.located(o, p), spark.createDataFrame([("m", "a")], "part string, sheet string")).collect()
    assert [(r.sheet, r.part, r.other) for r in wrong] == [("a", "m", "b")]
    assert locate.misnamed(locate.located(o, p), spark.createDataFrame([("m", "b")], "part string, sheet string")).count() == 0
