"""Which images are parts of which overview, from their names and sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths


def _keyed(candidates: DataFrame) -> DataFrame:
    """part_id, set_dir, pixels, path, key, marker: the keys under which an overview's own tokens find a candidate; of several such markers the first counts."""
    spread = candidates.select(F.col("id").alias("part_id"), "set_dir", "pixels", "path", "tokens", F.posexplode("tokens").alias("at", "token")).withColumn("marker", names.marker(F.col("token"))).filter("marker IS NOT NULL")
    rest = F.concat(F.slice("tokens", 1, F.col("at")), F.slice("tokens", F.col("at") + 2, F.size("tokens")))
    return spread.withColumn("key", F.array_join(rest, "\u0001")).groupBy("part_id", "set_dir", "pixels", "path", "key").agg(F.min_by("marker", "at").alias("marker"))


def _whole(overviews: DataFrame) -> DataFrame:
    return overviews.select(F.col("id").alias("overview_id"), "set_dir", F.array_join("tokens", "\u0001").alias("key"), F.col("pixels").alias("total"))


# Overviews that meet a part in one row of the join, and parts of one key that one task takes until there are the most shares of a key.
BLOCK = 128
SHARE = 4096
SHARES = 64


def _shares(parts: Column) -> Column:
    return F.least(F.ceil(parts / SHARE), F.lit(SHARES)).alias("shares")


def _met(whole: DataFrame, parts: DataFrame, sizes: DataFrame, own: list[str], seen: list[str], carried: list[str]) -> DataFrame:
    """``carried`` of ``parts`` with ``found``, up to about ``BLOCK`` overviews (``seen``, the largest first) that agree in ``own``.

    ``sizes`` has the number of blocks and of shares for each ``own``.  A part meets each block of its own once.  The parts are dealt in
    shares, each of which gets all blocks, so that a key of many copies is not one task; a task goes through a block's parts before it
    turns to the next block.
    """
    block = F.pmod(F.xxhash64("overview_id"), F.col("blocks")).alias("block")
    blocks = whole.join(sizes, own).groupBy(*own, "shares", block).agg(F.sort_array(F.collect_list(F.struct(*seen)), False).alias("found"))
    # one column, never null and of one type on both sides, so that the join takes the partitions as they are dealt below
    at = lambda share: F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own], F.coalesce(share, F.lit(0)).alias("share")).alias("at")
    blocks = blocks.select("found", *own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")).select("found", at(F.col("share")))
    dealt = parts.join(sizes, own).select(*carried, at(F.pmod(F.xxhash64("part_id"), F.col("shares"))))
    # partitions whose number is given stay as many: few bytes come in here, and many rows go out; coalesce to the same number parts the
    # join from what comes after it, else one block with all its parts is spread out in memory before the first row goes on
    many = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(many, "at").join(dealt.repartition(many, "at").hint("merge"), "at").drop("at").coalesce(many)


def matches(overviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """overview_id, part_id, marker, pixels, path, total of parts: both sides have id, set_dir, tokens, pixels, path.

    A part has the overview's tokens and one marker more, fewer pixels, the same set, and is another file.
    Leaving each marker out of a candidate's tokens gives the keys under which an overview's own tokens find
    it, so this is one equi-join.  Its rows are the pairs themselves, and grow with the square of the copies of a name:
    ``collapse``, ``verdicts`` and ``losers`` do without them.  A block of overviews meets a part at once, so the pairs come out
    as runs of one part over the same few overviews again and again, which files of columns hold in a fraction of a byte a row.
    """
    keyed, whole, own = _keyed(candidates), _whole(overviews), ["set_dir", "key"]
    held = whole.groupBy(*own).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = keyed.groupBy(*own).agg(_shares(F.count("*"))).join(held, own)
    pairs = _met(whole, keyed, sizes, own, ["total", "overview_id"], ["part_id", "marker", "pixels", "path"]).select("part_id", "marker", "pixels", "path", F.explode("found").alias("o"))
    return pairs.filter("pixels < o.total AND part_id <> o.overview_id").select("o.overview_id", "part_id", "marker", "pixels", "path", "o.total")


GROUP = ["set_dir", "key", "marker"]


def _levels(keyed: DataFrame, whole: DataFrame) -> DataFrame:
    """set_dir, key, total, marker, level, upto, first, second: what overviews of one key and total find under a marker.

    Copies are one row: ``level`` is the most pixels below the total, ``upto`` the number of candidates up to it, ``first`` and
    ``second`` the best two of these (part_id, path, pixels).
    """
    sound = keyed.filter("pixels IS NOT NULL")
    place = W.partitionBy(*GROUP, "pixels").orderBy(F.length("path"), F.lower("path"), "path", "part_id")
    best = sound.withColumn("n", F.row_number().over(place)).filter("n <= 2").withColumn("p", F.struct("part_id", "path", "pixels"))
    two = best.groupBy(*GROUP, "pixels").agg(*[F.max(F.when(F.col("n") == n, F.col("p"))).alias(name) for n, name in ((1, "first"), (2, "next"))])
    up = W.partitionBy(*GROUP).orderBy("pixels")
    levels = (
        sound.groupBy(*GROUP, "pixels").agg(F.count("*").alias("held")).join(two, [*GROUP, "pixels"])
        .withColumn("upto", F.sum("held").over(up.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("second", F.coalesce("next", F.lag("first").over(up))).withColumn("above", F.lead("pixels").over(up))
    )
    totals = whole.select("set_dir", "key", "total").distinct()
    return totals.join(levels, ["set_dir", "key"]).filter("pixels < total AND (above IS NULL OR total <= above)").select("set_dir", "key", "total", "marker", F.col("pixels").alias("level"), "upto", "first", "second")


def _own(whole: DataFrame, keyed: DataFrame) -> DataFrame:
    """``whole`` with the marker, pixels and path under which an overview would find itself."""
    own = keyed.select("set_dir", "key", F.col("part_id").alias("overview_id"), F.col("marker").alias("own_marker"), F.col("pixels").alias("own_pixels"), F.col("path").alias("own_path"))
    return whole.join(own, ["set_dir", "key", "overview_id"], "left")


def collapse(overviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """One part for each overview and marker: most pixels, then the shortest path, then its order; with the losers' number.

    Ids are unique on both sides.  No pair is made: overviews of one key and total differ only in that none finds itself.
    """
    keyed, whole = _keyed(candidates), _whole(overviews)
    met = _own(whole, keyed).join(_levels(keyed, whole), ["set_dir", "key", "total"])
    itself = F.coalesce((F.col("own_marker") == F.col("marker")) & (F.col("own_pixels") < F.col("total")), F.lit(False))
    best = F.when(F.col("first.part_id") == F.col("overview_id"), F.col("second")).otherwise(F.col("first"))
    held = met.withColumn("found", F.col("upto") - itself.cast("int")).withColumn("b", best).filter("found > 0")
    return held.select("overview_id", "marker", "total", "b.*", (F.col("found") - 1).alias("losers"))


def _held(seen: DataFrame, group: list[str], order: str) -> DataFrame:
    """``seen`` with ``kept_path``: what was kept when a part lost; null for the best of all."""
    rank = F.struct((-F.col("pixels")).alias("p"), F.length("path").alias("n"), F.lower("path").alias("l"), F.col("path").alias("path"))
    window = W.partitionBy(*group).orderBy(order)
    own = seen.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(window.rowsBetween(W.unboundedPreceding, 0)))
    # the next best one: lead goes through a group once, a frame up to its end once for each row
    later = F.expr(f"lead(_found) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{c}`' for c in group)} ORDER BY `{order}`)")
    own = own.withColumn("_found", F.when(F.col("_best.path") == F.col("path"), F.col("path")))
    return own.withColumn("_later", later).withColumn("kept_path", F.when(F.col("_best.path") != F.col("path"), F.col("_best.path")).otherwise(F.col("_later"))).drop("_rank", "_found", "_later")


def losers(overviews: DataFrame, candidates: DataFrame, order: str = "part_id") -> DataFrame:
    """overview_id, marker, path, kept_path of the parts that lost, in the order they were seen.

    A part that comes second to the best so far loses to that one at once; a best one loses to the next that
    beats it.  So the pointer is what was kept at the time of the loss, not the final winner.

    Overviews of one key whose totals let the same candidates in share one sequence, which is one window and is worked out once.
    An overview that is in the sequence itself changes only what lost to it: those rows, with the one that beat it at their
    end, are worked out once more without it.  The pairs are only the rows that come out; no step sorts or shuffles them, and as in
    ``matches`` a block of overviews meets a part that lost at once.
    """
    keyed, whole = _keyed(candidates), _whole(overviews)
    line = [*GROUP, "level"]
    levels = _levels(keyed, whole).select("set_dir", "key", "total", "marker", "level", "upto")
    # given partitions, since a part comes in once and goes on in a row for each level, through the windows below
    many = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = levels.select(*line).distinct().repartition(many, *GROUP).join(keyed.filter("pixels IS NOT NULL").repartition(many, *GROUP), GROUP).filter("pixels <= level")
    held = _held(lines, line, order)
    lost = held.filter("kept_path IS NOT NULL").select(*line, "part_id", "path", "pixels", "kept_path")
    # the part at whose loss a best one was replaced ends what is worked out again without that best one
    ends = held.filter("_best.path = path").select(*line, "part_id", "path", "pixels", F.lag("path").over(W.partitionBy(*line).orderBy(order)).alias("without")).filter("without IS NOT NULL")
    again = lost.withColumnRenamed("kept_path", "without").withColumn("real", F.lit(True)).unionByName(ends.withColumn("real", F.lit(False)))
    other = _held(again, [*line, "without"], order).filter("real AND kept_path IS NOT NULL").select(*line, "without", "path", "kept_path")
    looking = _own(whole, keyed).join(levels, ["set_dir", "key", "total"]).select(*line, "overview_id", "own_path")
    sizes = whole.join(levels, ["set_dir", "key", "total"]).groupBy(*line).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), _shares(F.max("upto")))
    pairs = _met(looking, lost, sizes, line, ["overview_id", "own_path"], ["part_id", "marker", "path", "kept_path"]).select("part_id", "marker", "path", "kept_path", F.explode("found").alias("o"))
    plain = pairs.filter("part_id <> o.overview_id AND (o.own_path IS NULL OR kept_path <> o.own_path)").withColumn("overview_id", F.col("o.overview_id"))
    changed = looking.join(other.withColumnRenamed("without", "own_path"), [*line, "own_path"])
    columns = ["overview_id", "marker", "path", "kept_path"]
    return plain.select(*columns).unionByName(changed.select(*columns))


def verdicts(overviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """overview_id, n_parts, markers, area (percent, rounded half to even), found: yes, partial or no."""
    kept = collapse(overviews, candidates).groupBy("overview_id").agg(F.array_sort(F.collect_list("marker")).alias("m"), F.sum("pixels").alias("covered"))
    joined = overviews.select(F.col("id").alias("overview_id"), "pixels").join(kept, "overview_id", "left")
    marks = F.coalesce("m", F.array().cast("array<string>"))
    raw = F.when(F.col("pixels") > 0, F.coalesce("covered", F.lit(0)) * 100.0 / F.col("pixels")).otherwise(0.0)
    return joined.select("overview_id", F.size(marks).alias("n_parts"), names.marker_text(marks).alias("markers"), F.bround(raw).cast("int").alias("area"), names.parts_found(marks, raw).alias("found"))


def over_threshold(size: Column, pixels: Column, megabytes: float = 100, megapixels: float = 89) -> Column:
    return (size > megabytes * 2**20) | (pixels > megapixels * 1e6)


def should_zip(mode: str, combined: Column, found: Column) -> Column:
    return {"none": F.lit(False), "all": F.lit(True), "combined": combined, "combined-with-parts": combined & (found == "yes")}[mode]


def says_combined(path: Column) -> Column:
    return F.lower(path).contains("combined")


def evidence(name_combined: Column, n_parts: Column, markers: Column, area: Column, found: Column) -> Column:
    some = n_parts > 0
    phrase = F.when(some, F.format_string("%d part maps of same variant in set", n_parts)).otherwise("no lettered/pt part maps of this map in set")
    head = F.when(name_combined, F.concat(F.lit("name/folder says Combined; "), phrase)).when(some, phrase).otherwise(F.concat(F.lit("no Combined in name; "), phrase))
    run = F.when(found == "no", "no parts").when(found == "partial", "parts present, area under 80, run incomplete").when(area < 80, "letter/digit run from a/1").otherwise("area>=80")
    return F.concat(head, F.lit("; rule="), run, F.lit("; letters="), markers, F.lit("; area="), area.cast("string"), F.lit("%"))


def fit_within(width: Column, height: Column, most: int) -> Column:
    """struct<width, height>: scaled down to ``most`` on the long side, never up, at least one pixel."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(*[F.greatest(F.lit(1), F.bround(x * scale).cast("int")).alias(n) for n, x in (("width", width), ("height", height))])


def set_of(path: Column, levels: int = 1) -> Column:
    return paths.set_directory(path, levels)


# Long sides that are tried below the one asked for, and qualities from the best on.
STANDIN_EDGES = (8000, 4000, 2000, 1600, 1200, 800, 400, 200, 100, 64, 32)
STANDIN_QUALITIES = (90, 70, 50, 30, 15, 5)


def first_fit(cap: Column, edges: Column, qualities: Column, size: Callable[[Column, Column], Column]) -> Column:
    """struct<edge, quality, bytes> of the first stand-in of at most ``cap`` bytes: edges from the largest, each with all qualities; null if none fits.

    ``size`` says what an edge and a quality come to, never more for less of either.  So the first edge that has a fit is the first
    whose last quality fits, and both places are found by halving: no grid is tried.
    """
    last = F.element_at(qualities, -1)
    fits = lambda edge, quality: F.coalesce(size(edge, quality) <= cap, F.lit(False))
    at = first_true(F.size(edges), lambda n: fits(F.get(edges, n), last))
    edge = F.get(edges, at)
    quality = F.get(qualities, first_true(F.size(qualities), lambda n: fits(edge, F.get(qualities, n))))
    return F.when(at < F.size(edges), F.struct(edge.alias("edge"), quality.alias("quality"), size(edge, quality).alias("bytes")))


def first_true(count: Column, test: Callable[[Column], Column], halvings: int = 7) -> Column:
    """The least n from 0 to ``count`` - 1 for which ``test`` is true (``count`` if none), where it stays true from there on; up to 2 ** ``halvings`` - 1 places."""
    low_high = F.struct(F.lit(0).alias("low"), count.cast("int").alias("high"))

    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        return F.when(at["low"] >= at["high"], at).when(test(middle), F.struct(at["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), at["high"].alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), low_high, halved, lambda at: at["low"])


def standin_choice(files: DataFrame, max_dim: int = 8000, quality: int = 90) -> DataFrame:
    """Files (size, width, height, ext, cap) with edge, quality, bytes of their stand-in; nulls where none fits or a size is unknown.

    Its size is that of the file, less by the share of pixels and, but for PNG, by quality over one hundred, rounded down.
    """
    edges = F.array(*[F.lit(e) for e in dict.fromkeys([max_dim, *[e for e in STANDIN_EDGES if e < max_dim]])])
    few = [q for q in STANDIN_QUALITIES if q <= quality] or [quality]
    png = F.lower("ext") == ".png"
    levels = F.when(png, F.array(F.lit(quality))).otherwise(F.array(*map(F.lit, few)))
    long = F.greatest("width", "height")

    def size(edge: Column, level: Column) -> Column:
        shrink = F.least(F.lit(1.0), edge / long)
        return F.floor(F.col("size") * shrink * shrink * F.when(png, 1.0).otherwise(level / 100.0)).cast("bigint")

    return files.withColumn("_fit", first_fit(F.col("cap"), edges, levels, size)).select("*", "_fit.edge", "_fit.quality", "_fit.bytes").drop("_fit")
