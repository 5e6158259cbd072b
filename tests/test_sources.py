import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import names, paths, sniff, web
from foliant.operators import actions, feed, geometry, staging, tagging
from foliant.sources import archives, documents


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_zip_listing_goes_into_inner_archives(spark):
    inner = zipped({"tiny.txt": b"x"})
    blobs = spark.createDataFrame([("a.zip", bytearray(zipped({"t.png": b"123", "nested/inner.zip": inner}))), ("bad.zip", bytearray(b"PK nonsense"))], "path string, content binary")
    rows = archives.zip_entries(blobs).collect()
    assert {(r.path, r.inner_path, r.depth) for r in rows if not r.error} == {("a.zip", "t.png", 0), ("a.zip", "nested/inner.zip", 0), ("a.zip!nested/inner.zip", "tiny.txt", 1)}
    assert [r.path for r in rows if r.error] == ["bad.zip"]


def test_members_of_tar_and_zip(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, kind in (("a.txt", tarfile.REGTYPE), ("l", tarfile.SYMTYPE), ("A.TXT", tarfile.REGTYPE)):
            info = tarfile.TarInfo(name)
            info.type = kind
            t.addfile(info, io.BytesIO())
    blobs = spark.createDataFrame([("x.tar.gz", bytearray(out.getvalue()))], "path string, content binary")
    got = {r["name"]: r.reason for r in archives.mark_repeats(archives.archive_members(blobs)).collect()}
    assert got == {"a.txt": None, "l": "symlink", "A.TXT": "duplicate"}


def test_inventory_walk(spark, tmp_path):
    for p in ("a/x.txt", "b/.git/y.txt", "b/z.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("hello")
    got = archives.files(spark, str(tmp_path)).collect()
    assert sorted((r.relpath, r.size) for r in got) == [("a/x.txt", 5), ("b/z.png", 5)]


def test_dimensions(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + bytes(20)
    blobs = spark.createDataFrame([("p", bytearray(png)), ("j", bytearray(jpg)), ("n", bytearray(b""))], "path string, content binary")
    assert {r.path: (r.width, r.height, r.kind) for r in archives.dimensions(blobs).collect()} == {"p": (640, 480, "png"), "j": (30, 20, "jpeg"), "n": (None, None, None)}


def test_comments_and_config():
    assert documents.load_config('{"a": "x // y", /* b */ "c": 1 // d\n}') == {"a": "x // y", "c": 1}
    assert documents.extension_groups({"archives": [".zip"], "archives_optional": ["7z"], "other": [".ZIP"]}) == {".zip": "archives", ".7z": "archives"}


def test_manifest_lines(spark):
    sha = "0" * 64
    lines = [f"a/b\t3\t{sha}", "x\ty", f"../q\t1\t{sha}", f"c\t-1\t{sha}", "d\t1\tzz", f"a/b\t3\t{sha}"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    assert [r.error for r in documents.parse_manifest(frame).orderBy("line").collect()] == [None, "fields", "path", "size", "sha256", "duplicate"]


def test_undo_log():
    rows = documents.read_undo("\ufeffAction,Source,Destination,Size,SHA256,Timestamp\n\nMOVE,a,b\n")
    assert rows == [{"action": "MOVE", "source": "a", "destination": "b", "size": "", "sha256": "", "timestamp": ""}]
    with pytest.raises(ValueError):
        documents.read_undo("x,y\n")


def test_export_and_log(spark):
    frame = spark.createDataFrame([(1, None, True, ["a", "b"])], "n int, s string, b boolean, l array<string>")
    assert documents.export_table(frame).first().asDict() == {"n": "1", "s": "", "b": "true", "l": "a | b"}
    log = spark.createDataFrame([("debug", "x", "k"), ("error", "session_id=abc; q", "v")], "level string, event string, token string")
    (row,) = documents.log_lines(log).collect()
    assert json.loads(row.value) == {"level": "error", "event": "session_id=[redacted]; q", "token": "[redacted]"}


def test_schema_errors():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}, "maxItems": 2}, "c": {"$ref": "#/defs/s"}}, "defs": {"s": {"type": "string", "pattern": "^q"}}}
    assert documents.schema_errors({"a": 1, "b": ["x"], "c": "qq"}, schema) == []
    assert len(documents.schema_errors({"a": 0, "b": ["y", "x", "x"], "c": "z", "d": 1}, schema)) == 5
    assert documents.schema_errors({}, schema) == ["$.a: missing"]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("2024/01/shot.png", ("_unknown", "_root", "shot.png")), ("Artist/Pack/tokens/orc.png", ("Artist", "Pack", "tokens/orc.png")), ("2024/01/A/02/B/x", ("A", "02", "B/x")), ("x", ("_unknown", "_root", "x")), ("2024_05_06/A/x", ("A", "_root", "x"))],
)
def test_bundle_and_pack(spark, path, expected):
    row = spark.createDataFrame([(path,)], "p string").select(paths.bundle_and_pack(F.col("p")).alias("s")).first().s
    assert tuple(row) == expected


@pytest.mark.parametrize(("name", "expected"), [(".bashrc", ""), ("a.", ""), ("a.tar.gz", ".gz"), ("..foo", ".foo"), ("x", "")])
def test_suffix(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(paths.suffix(F.col("n"))).first()[0] == expected


def test_rules(spark):
    cases = [
        ("a.pdf", ".pdf", 10, b"%PDF-1.4", ("_Documents", "high", "ext-pdf")),
        ("a.docx", ".docx", 10, b"PK\x03\x04", ("_Documents", "high", "ext-docx")),
        ("pack.7z", ".7z", 10, bytes.fromhex("377ABCAF271C"), ("_Archives", "high", "magic-7z")),
        ("setup.msi", ".msi", 10, bytes.fromhex("D0CF11E0"), ("_Installers", "high", "magic-ole-msi")),
        ("w.pt", ".pt", 60 << 20, b"", ("_ModelWeights", "high", "size-large-weight")),
        ("Battlemap.png", ".png", 1, b"", ("_Maps", "low", "name-map")),
        ("x", "", 1, None, ("_Unknown", "unsure", "none")),
    ]
    frame = spark.createDataFrame([(n, e, s, None if h is None else bytearray(h)) for n, e, s, h, _ in cases], "n string, e string, s bigint, h binary")
    got = [tuple(r[0]) for r in frame.select(sniff.classify(F.col("n"), F.col("e"), F.col("s"), F.col("h"))).collect()]
    assert got == [c[-1] for c in cases]


def test_split_volumes_and_tokens(spark):
    cases = {"a.zip.001": ("numeric", "a.zip", 1), "name.part01.rar": ("rar_part", "name.rar", 1), "Map Part 1.zip": ("named_part", "Map.zip", 1), "a.zip.bad": None, "Map Pack #1.zip": None}
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select("n", names.split_volume(F.col("n")).alias("s")).collect()
    assert {r.n: r.s and (r.s["scheme"], r.s["base"], r.s["index"]) for r in rows} == cases
    row = spark.createDataFrame([("King's_Zone_F_Day_Gridless",)], "n string").select(names.part_tokens(F.col("n"))).first()[0]
    assert row == ["kings", "zone", "f", "day"]
    runs = spark.createDataFrame([(["b", "a"],), (["1", "2", "3"],), (["a", "c"],), (["a"],), (["10", "1"],)], "m array<string>").select(names.contiguous_run(F.col("m"))).collect()
    assert [r[0] for r in runs] == [True, True, False, False, False]


@pytest.mark.parametrize(
    ("name", "kind", "clean"),
    [("note.txt", "generic", True), ("Dnd_5e_Phandelver.pdf", "game-book", True), ("Dnd_Fan_5e_Phandelver.pdf", "game-book", True), ("Tolkien_1954_Fellowship_LordOfTheRings_01_coauth_Someone.pdf", "fiction", True),
     ("notLib_short_hint_20261016_1530.md", "review", True), ("pic_8k.jpg", "image", True), ("bad name.txt", "generic", False), ("a<b.txt", "generic", False), ("trail.", "generic", False), ("CON.txt", "generic", False), ("pic_4k.jpg", "image", False)],
)
def test_lint(spark, name, kind, clean):
    found = spark.createDataFrame([(name,)], "n string").select(names.lint(F.col("n"), F.lit(kind))).first()[0]
    assert (not found) == clean


def test_zip_batches_win_over_bursts(spark):
    rows = [("d/Pack.zip", "d", "Pack", ".zip", 0.0), ("d/Pack/inside.txt", "d/Pack", "inside", ".txt", 0.0), ("d/Pack.txt", "d", "Pack", ".txt", 0.0), ("d/loose-a", "d", "loose-a", "", 0.0), ("d/loose-b", "d", "loose-b", "", 10.0)]
    got = {r.rel: r.batch for r in tagging.batches(spark.createDataFrame(rows, "rel string, parent_rel string, stem string, ext string, mtime double")).collect()}
    assert got == {"d/Pack.zip": "zip:d/Pack", "d/Pack/inside.txt": "zip:d/Pack", "d/Pack.txt": "zip:d/Pack", "d/loose-a": "burst:d:0", "d/loose-b": "burst:d:0"}


def test_responses(spark):
    cases = [(200, "application/json", "2fa captcha", "/api/x", None, None, None), (401, "", "", "/api/x", None, None, "auth"), (403, "text/html", "Just a moment", "/x", None, None, "challenge"),
             (302, "", "", "/x", "https://h/login", None, "verification"), (200, "text/html", "", "https://h/login", None, None, "verification"), (429, "", "", "", None, None, "rate"), (403, "", "", "", None, "challenge", "challenge")]
    frame = spark.createDataFrame([c[:-1] for c in cases], "s int, c string, b string, u string, l string, m string")
    assert [r[0] for r in frame.select(web.response_kind(*[F.col(x) for x in "scbulm"])).collect()] == [c[-1] for c in cases]


def test_feed_page(spark):
    page = {
        "data": [{"id": "1", "type": "post", "attributes": {"title": "t", "published_at": "2025-01-02T00:00:00Z", "current_user_can_view": True, "content": '<a href="https://x.org/f">', "is_public": False},
                  "relationships": {"attachments": {"data": [{"id": "9", "type": "attachment"}, {"id": "8", "type": "media"}]}}}],
        "included": [{"id": "9", "type": "attachment", "attributes": {"name": "a.zip", "url": "https://c/a"}}, {"id": "8", "type": "other", "attributes": {"file_name": "b.png", "download_url": "https://c/b", "size_bytes": 5}}],
    }
    pages = spark.createDataFrame([(0, json.dumps(page))], "page int, payload string")
    post = feed.posts_of(pages).first()
    assert (post.post_id, post.can_view, post.gated, post.hrefs) == ("1", True, True, ["https://x.org/f"])
    assert sorted((m.media_id, m["name"], m.kind, m["size"]) for m in feed.media_of(pages).collect()) == [("8", "b.png", "loose-media", 5), ("9", "a.zip", "zip", None)]


def test_replay_sees_earlier_actions(spark):
    acts = [(0, "mkdir", None, "/d/new", None), (1, "move", "/d/a", "/d/new/a", None), (2, "copy", "/d/a", "/d/b", None), (3, "copy", "/d/new/a", "/d/b", "AA"), (4, "recycle", "/d/new", None, None), (5, "move", "/d/new/a", "/d/c", None), (6, "move", "/d", "/d/x", None)]
    frame = spark.createDataFrame([("p", *a) for a in acts], "plan string, idx bigint, op string, src string, dst string, sha256 string")
    there = spark.createDataFrame([("p", "/d/a", "file", "aa")], "plan string, path string, kind string, sha256 string")
    got = [(r.status, r.reason) for r in actions.replay(frame, there).orderBy("idx").collect()]
    assert [s for s, _ in got] == ["ok", "ok", "refused", "ok", "ok", "refused", "refused"]
    stopped = actions.replay(frame, there, stop_on_error=True).orderBy("idx").collect()
    assert [r.status for r in stopped] == ["ok", "ok", "refused", "skipped", "skipped", "skipped", "skipped"]


def test_clusters_and_lattice(spark):
    values = spark.createDataFrame([("s", float(v)) for v in (1, 2, 10, 11, 12, 30)], "sheet string, v double")
    assert geometry.clusters(values, "sheet", 3.0).first().centers == [1.5, 11.0, 30.0]
    grid = [("s", c, r, chr(ord("f") + r * 5 + c)) for r in range(3) for c in range(5) if (r, c) != (1, 2)]
    order = geometry.reading_order(spark.createDataFrame(grid, "sheet string, col int, row int, marker string"), "sheet").first()
    assert (order.order, order.first) == ("row", 5)
    centers = spark.createDataFrame([("s", [100.0, 164.0, 228.0])], "sheet string, centers array<double>")
    step = geometry.lattice_step(centers, "sheet", 2.0).first().step
    assert step == 64.0
    wide = geometry.extended(centers.withColumn("step", F.lit(64.0)), "sheet", 64, 400).first().centers
    assert wide == [36.0, 100.0, 164.0, 228.0, 292.0]


def test_cookies(spark):
    jar = [("zeta", "z", ".site", "/", None), ("session_id", "s1", "www.site", "/", -1.0), ("alpha", "a", ".site", "/", 50.0), ("foreign", "f", "other", "/", None)]
    frame = spark.createDataFrame(jar, "name string, value string, domain string, path string, expires double")
    row = staging.cookie_header(frame, ["site"], None, ["session_id"], 10.0).first()
    assert (row.header, row["count"], row.error) == ("alpha=a; session_id=s1; zeta=z", 3, None)
    assert staging.cookie_header(frame, ["site"], None, ["alpha"], 60.0).first().error == "required cookie alpha expired"
    assert staging.cookie_header(frame, ["site"], None, ["nope"], 60.0).first().error == "required cookie nope missing"
