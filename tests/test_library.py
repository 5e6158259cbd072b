from pyspark.sql import functions as F

from foliant.functions import numbers
from foliant.operators import dedupe, library, parts, staging
from foliant.plans.oracles import QUERIES


def test_plan_is_dry_by_default_then_copies_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / n).write_text(n * 5)
    lib = tmp_path / "lib"
    rows = [(1, str(tmp_path / "in/a"), str(lib / "x/a"), "copy"), (2, str(tmp_path / "in/b"), str(lib / "b"), "hardlink"), (3, str(tmp_path / "in/a"), str(tmp_path / "else/a"), "copy"), (4, str(tmp_path / "in/none"), str(lib / "n"), "copy")]
    plan = spark.createDataFrame(rows, "file_id bigint, src string, dest string, op string")
    dry = {r.file_id: r.result for r in library.apply_plan(plan, [str(lib)]).collect()}
    assert dry == {1: "would copy", 2: "would hardlink", 3: "error", 4: "would copy"} and not lib.exists()
    first = {r.file_id: r.result for r in library.apply_plan(plan, [str(lib)], dry_run=False).collect()}
    assert first == {1: "copy", 2: "hardlink", 3: "error", 4: "error"} and (lib / "x/a").read_text() == "aaaaa"
    again = library.apply_plan(plan, [str(lib)], dry_run=False)
    assert {r.result: r.n for r in library.outcome_counts(again).collect()} == {"skipped": 2, "error": 2}
    (lib / "x/a").write_text("other size")
    assert library.apply_plan(plan.filter("file_id = 1"), [str(lib)], dry_run=False).first().note == "destination has another size"


def test_manifest_check(spark):
    e = spark.createDataFrame([("a", "/t/a", "/t/a", 1, "AA"), ("b", "/t/b", "/t/c", 1, "bb"), ("c", "/t/c", "/t/c", 2, "cc"), ("m", "/t/m", "/t/m", 1, "x")], "src string, dest string, expected_dest string, size bigint, sha256 string")
    f = spark.createDataFrame([("a", 1, "aa"), ("b", 1, "bb"), ("c", 1, "cc"), ("z", 1, "zz")], "rel string, size bigint, sha256 string")
    got = {r.rel: r.problem for r in library.check_manifest(e, f).collect()}
    assert got == {"b": "unexpected destination", "c": "size differs", "m": "source is missing", "z": "not in the manifest"}


def test_action_validation(spark):
    rows = [("mkdir", None, "/a"), ("move", "a", "C:\\x"), ("recycle", "/a", "/b"), ("fly", None, None), ("copy", None, "\\\\h\\s")]
    frame = library.validate_actions(spark.createDataFrame(rows, "op string, src string, dst string"))
    assert [r.errors for r in frame.collect()] == [[], ["src is not absolute"], ["dst is not allowed"], ["unknown op"], ["src is missing"]]


def test_retarget_and_numbers(spark):
    frame = spark.createDataFrame([("Sets_F/Map_F_Day.png",), ("x/Map_pt3_a.png",)], "p string")
    assert frame.select(library.retargeted(F.col("p"), "f", "m")).first()[0] == "Sets_M/Map_M_Day.png"
    assert [r[0] for r in frame.select(library.retargeted(F.col("p"), "3", "4")).collect()][1] == "x/Map_pt4_a.png"
    row = spark.range(1).select(
        numbers.marker_index(F.lit("C")).alias("a"), numbers.refine_slop(F.lit(6400), F.lit(100)).alias("b"), numbers.backoff(F.lit(3), F.lit(None).cast("int")).alias("c"),
        numbers.backoff(F.lit(1), F.lit(500)).alias("d"), numbers.finite(F.lit(float("nan"))).alias("e"), numbers.area_percent(F.lit(5), F.lit(200)).alias("f"),
        parts.fit_within(F.lit(4000), F.lit(2000), 1000).alias("g"), numbers.retry_after(F.lit(" 7 ")).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, tuple(row.g), row.h) == (2, 22, 4.0, 120.0, 0.0, 2, (1000, 500), 7)


def test_upsert_and_incremental_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in dedupe.upsert(old, new, "k").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    files = spark.createDataFrame([(1, 3, "abc"), (2, 3, "abc"), (3, 3, "abd"), (4, 0, ""), (5, 9, "abcdefghi")], "id bigint, size bigint, content string")
    cold = {(r.id, r.sha256) for r in dedupe.cascade(files).collect()}
    assert {i for i, _ in cold} == {1, 2, 4}
    known = spark.createDataFrame([(i, s) for i, s in cold if i == 1], "id bigint, sha256 string")
    assert {(r.id, r.sha256) for r in dedupe.cascade(files, known=known).collect()} == cold  # the new copy of a known file is found


def test_single_file_outcomes(spark):
    cases = [(True, "a", "b", "a", False, False, "placed"), (True, "a", "a", "a", False, False, "unchanged"), (True, "a", "b", "c", False, False, "stale"), (False, None, "b", "c", False, False, "missing"), (True, "a", "b", None, True, False, "exists"), (False, None, "b", None, True, True, "would-place")]
    frame = spark.createDataFrame([c[:-1] for c in cases], "e boolean, cur string, st string, ex string, n boolean, d boolean")
    got = [r[0] for r in frame.select(staging.single_status(*[F.col(c) for c in ("e", "cur", "st", "ex", "n", "d")])).collect()]
    assert got == [c[-1] for c in cases]


def test_reports():
    text = library.summary_markdown({"files": 3}, [{"source_name": "s", "files": 3, "bytes": 5}], [{"sha256": "f" * 64, "extra_count": 1, "wasted_bytes": 5, "canonical_path": "/p"}])
    assert "- files: 3" in text and "| s | 3 | 5 |" in text and "`ffffffffffff` 1 extra" in text
    assert "- .x: 2" in library.exceptions_markdown([{"ext": ".x", "n": 2}], ["/o"], [("/e", "bad")])


def test_clusters_and_lattices_of_every_order(spark, sf_dir):
    sheets = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v")).collect():
        sheets.setdefault(r.l_orderkey, []).append((r.l_linenumber - 1, r.v))

    def centers(values):
        out = []
        for v in sorted(values):
            if out and v - sum(out[-1]) / len(out[-1]) <= 3.0:
                out[-1].append(v)
            else:
                out.append([v])
        return [round(sum(c) / len(c), 6) for c in out]

    def order(cells):
        cols, rows = max(n % 3 for n in cells) + 1, max(n // 3 for n in cells) + 1
        first = {"row": {n - (n // 3 * cols + n % 3) for n in cells}, "col": {n - (n % 3 * rows + n // 3) for n in cells}}
        fits = [k for k, f in first.items() if len(f) == 1 and 0 <= min(f) <= 26 - cols * rows]
        if len(fits) == 2 and not (min(cols, rows) == 1 and len(cells) == cols * rows):
            fits = []
        return (fits[0], min(first[fits[0]])) if fits else (None, None)

    got = QUERIES["running_clusters"](spark, sf_dir).collect()
    assert {r.sheet: [round(c, 6) for c in r.centers] for r in got} == {k: centers(v for _, v in rows) for k, rows in sheets.items()}
    got = QUERIES["lattice_cells"](spark, sf_dir).collect()
    assert {r.sheet: (r.order, r.first) for r in got} == {k: order([n for n, _ in rows]) for k, rows in sheets.items()}
