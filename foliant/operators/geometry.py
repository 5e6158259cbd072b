"""Rectangles and lattices on sheets: one sheet is one group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clipped(rects: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles (x, y, w, h) cut to the sheet; empty ones go."""
    x1, y1 = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    x2, y2 = F.least(F.col("x") + F.col("w"), F.lit(width)), F.least(F.col("y") + F.col("h"), F.lit(height))
    return rects.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).filter("x2 > x1 AND y2 > y1")


def union_area(rects: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key, area covered by at least one rectangle of the key, exactly.

    Between two neighbouring edges in x the rectangles that span the strip are fixed, so a strip's covered
    height is the union of their y intervals: a fold over sorted intervals.  A sheet's rectangles are one array.
    """
    own = clipped(rects, width, height).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y1", "y2", "x1", "x2"))).alias("r"))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("r", lambda s: s["x1"]), F.transform("r", lambda s: s["x2"]))))
    strips = own.withColumn("e", edges).select(key, "r", F.explode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("a"), F.slice("e", 2, F.size("e") - 1).alias("b"))).alias("s"))
    span = F.filter("r", lambda q: (q["x1"] <= F.col("s.a")) & (q["x2"] >= F.col("s.b")))
    covered = F.aggregate(
        span,
        F.struct(F.lit(0).cast("bigint").alias("top"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, q: F.struct(F.greatest(acc["top"], q["y2"].cast("bigint")).alias("top"), (acc["sum"] + F.greatest(F.lit(0).cast("bigint"), q["y2"] - F.greatest(acc["top"], q["y1"].cast("bigint")))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return strips.select(key, ((F.col("s.b") - F.col("s.a")) * covered).alias("part")).groupBy(key).agg(F.sum("part").alias("area"))


def overlapping(rects: DataFrame, key: str) -> DataFrame:
    """key, a, b: ids of rectangles of one sheet that share an inner point."""
    a, b = rects.alias("a"), rects.alias("b")
    meet = "a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.expr(meet)).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def median_spread(values: DataFrame, key: str) -> DataFrame:
    """key, median, spread: the largest relative distance from the median (0 for a median of 0 or less)."""
    m = values.groupBy(key).agg(F.percentile("v", 0.5).alias("median"))
    far = F.max(F.abs(F.col("v") - F.col("median")) / F.col("median"))
    return values.join(m, key).groupBy(key).agg(F.first("median").alias("median"), F.when(F.first("median") > 0, far).otherwise(0.0).alias("spread"))


def clusters(values: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, centers: sorted values joined while they lie within ``tolerance`` above the open cluster's mean."""
    own = values.groupBy(key).agg(F.array_sort(F.collect_list(F.col("v").cast("double"))).alias("v"))
    start = F.struct(F.expr("CAST(array() AS array<double>)").alias("done"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(
        (acc["n"] > 0) & (x - acc["sum"] / F.greatest(acc["n"], F.lit(1)) <= tolerance), F.struct(acc["done"].alias("done"), (acc["sum"] + x).alias("sum"), (acc["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["sum"] / F.greatest(acc["n"], F.lit(1))))).otherwise(acc["done"]).alias("done"), x.alias("sum"), F.lit(1).alias("n")))
    return own.select(key, F.aggregate("v", start, step, lambda acc: F.concat(acc["done"], F.array(acc["sum"] / F.greatest(acc["n"], F.lit(1))))).alias("centers"))


def lattice_step(centers: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, step: the median gap of neighbouring centers, null if there is none or some gap is off by more than the
    tolerance and four hundredths of it."""
    c = F.col("centers")
    gaps = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: x - F.get(c, i))
    whole = F.array_sort(F.transform(gaps, lambda g: F.bround(g)))
    n = F.size(whole)
    middle = (F.get(whole, F.floor((n - 1) / 2).cast("int")) + F.get(whole, F.floor(n / 2).cast("int"))) / 2
    even = F.forall(gaps, lambda g: F.abs(g - F.col("_m")) <= F.greatest(F.lit(tolerance), 0.04 * F.col("_m")))
    return centers.withColumn("_m", F.when(n > 0, middle)).select(key, F.when(F.col("_m").isNotNull() & even, F.col("_m")).alias("step"))


def extended(centers: DataFrame, key: str, size: float, limit: float, most: int = 30) -> DataFrame:
    """centers (with their step) carried on to both borders of the sheet, at most ``most`` on each side."""
    c, s = F.col("centers"), F.col("step")
    below = F.least(F.floor((c[0] + 1) / s), F.lit(most)).cast("int")
    above = F.least(F.floor((F.lit(limit) + 1 - size - F.element_at(c, -1)) / s), F.lit(most)).cast("int")
    none = F.expr("CAST(array() AS array<double>)")
    before = F.when(below > 0, F.transform(F.sequence(below, F.lit(1)), lambda k: c[0] - k * s)).otherwise(none)
    after = F.when(above > 0, F.transform(F.sequence(F.lit(1), above), lambda k: F.element_at(c, -1) + k * s)).otherwise(none)
    return centers.withColumn("centers", F.when(s > 1, F.concat(before, c, after)).otherwise(c))


def reading_order(cells: DataFrame, key: str) -> DataFrame:
    """key, order (row, col or null), first: how the markers of (col, row, marker) run over the lattice.

    Letters a to z or numbers 1 to 99 fit an order if marker minus cell index is one number for all cells and
    every cell's marker exists.  Two fits count only where they agree on a full lattice.
    """
    letters = F.bool_and(F.col("marker").rlike("^[a-z]$"))
    digits = F.bool_and(F.col("marker").rlike(r"^\d+$"))
    value = F.when(F.col("marker").rlike("^[a-z]$"), F.ascii("marker") - 97).otherwise(F.col("marker").try_cast("int"))
    shape = cells.groupBy(key).agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"), letters.alias("letters"), digits.alias("digits"))
    placed = cells.join(shape, key).withColumn("by_row", value - (F.col("row") * F.col("cols") + F.col("col"))).withColumn("by_col", value - (F.col("col") * F.col("rows") + F.col("row")))
    fits = placed.groupBy(key, "cols", "rows", "letters", "digits").agg(*[f(c).alias(f"{n}_{c}") for c in ("by_row", "by_col") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("cells"))
    size = F.col("cols") * F.col("rows")
    legal = lambda first: F.when(F.col("letters"), (first >= 0) & (first + size - 1 <= 25)).when(F.col("digits"), (first >= 1) & (first + size - 1 <= 99)).otherwise(F.lit(False))
    ok = lambda c: F.coalesce((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & legal(F.col(f"lo_{c}")), F.lit(False))
    same = ((F.col("cols") == 1) | (F.col("rows") == 1)) & (F.col("cells") == size)
    order = F.when(ok("by_row") & ok("by_col"), F.when(same, "row")).when(ok("by_row"), "row").when(ok("by_col"), "col")
    return fits.select(key, order.alias("order"), F.when(order == "row", F.col("lo_by_row")).when(order == "col", F.col("lo_by_col")).alias("first"))


def nearest_sibling(missing: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """cell, sibling: the located part with the least index distance, the first of equals.

    Parts without an index (below 0) are as far as their corner is from the cell's, in x and y together; without the
    columns x and y on both sides there are none such.
    """
    placed = {"x", "y"} <= set(missing.columns) & set(located.columns)
    other = located.withColumnsRenamed({"x": "_x", "y": "_y"}) if placed else located
    far = F.abs(F.col("cell_index") - F.col("part_index"))
    if placed:
        far = F.when(F.col("part_index") < 0, F.abs(F.col("x") - F.col("_x")) + F.abs(F.col("y") - F.col("_y"))).otherwise(far)
    return missing.join(other, key).groupBy(key, "cell").agg(F.min_by("part", F.struct(far, F.col("part_order"))).alias("sibling"))


def missing_cells(cells: DataFrame, located: DataFrame, key: str, slack: int = 2) -> DataFrame:
    """Cells (key, cell, x, y) near which no part (key, x, y) was located: farther than ``slack`` in x or y from all of its sheet.

    Cells and parts meet once, by sheet: the distinct places of a sheet's parts are one array, which lies beside each of its cells.
    """
    parts = located.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col(key).alias("_k")).agg(F.collect_set(F.struct(F.col("x").alias("px"), F.col("y").alias("py"))).alias("_p"))
    near = F.exists("_p", lambda p: (F.abs(F.col("x") - p["px"]) <= slack) & (F.abs(F.col("y") - p["py"]) <= slack))
    met = cells.join(parts, F.col(key) == F.col("_k"), "left")
    return met.filter(~F.coalesce(near, F.lit(False))).select(*cells.columns)


def padding(rects: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key, pixels, notes: flat strips between the sheet's edges and its parts (x, y, w, h), two pixels wide or more, corners once.

    ``flat`` (a boolean for each of top, bottom, left, right, on any row of the sheet) says which strips are flat; without
    these columns all are.
    """
    flat = lambda side: F.bool_and(side) if side in rects.columns else F.lit(True)
    e = rects.groupBy(key).agg(F.min("y").alias("top"), (height - F.max(F.col("y") + F.col("h"))).alias("bottom"), F.min("x").alias("left"), (width - F.max(F.col("x") + F.col("w"))).alias("right"), *[flat(s).alias(f"flat_{s}") for s in ("top", "bottom", "left", "right")])
    strip = {s: F.when(F.col(f"flat_{s}") & (F.col(s) >= 2), F.col(s)).otherwise(0) for s in ("top", "bottom", "left", "right")}
    across, down = strip["top"] + strip["bottom"], strip["left"] + strip["right"]
    notes = F.concat_ws(", ", *[F.when(strip[s] > 0, F.format_string(f"{s} %dpx", strip[s])) for s in strip])
    return e.select(key, (across * width + down * height - across * down).alias("pixels"), F.when(notes == "", "none").otherwise(notes).alias("notes"))
