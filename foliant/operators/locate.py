"""Finding part images in their overview: normalised cross-correlation over a grid of scales.

Images are grey pixels (binary, one byte each, row by row) with width and height.  Each pair of overview and
part is one row, so pairs spread over the cluster and none waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from . import geometry, numbering
from .tables import written

# Least score, margin and coverage that count, long side of the coarse search, and steps of the two scale grids.
LEAST_SCORE, LEAST_MARGIN, LEAST_COVERAGE, COARSE = 0.90, 0.05, 0.97, 192
COARSE_STEPS, FINE_STEPS = 9, 9
HITS = "sheet string, part string, x int, y int, w int, h int, score double, margin double, tries int"


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over each target pixel's area when shrinking, bilinear when growing."""
    h, w = image.shape
    if (w, h) == (width, height):
        return image.astype(float)
    if width <= w and height <= h:
        total = np.zeros((h + 1, w + 1))
        total[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
        ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)

        def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
            fy, fx = (y - y0)[:, None], (x - x0)[None, :]
            corner = lambda a, b: total[np.ix_(y0 + a, x0 + b)]
            return (1 - fy) * ((1 - fx) * corner(0, 0) + fx * corner(0, 1)) + fy * ((1 - fx) * corner(1, 0) + fx * corner(1, 1))

        s = at(ys, xs)
        area = np.outer(np.diff(ys), np.diff(xs))
        return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / area
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y, x = y.clip(0, h - 1), x.clip(0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    pick = lambda a, b: image[np.ix_(a, b)].astype(float)
    return (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1))


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at each place where the template fits (0 where either is flat)."""
    th, tw = template.shape
    t = template - template.mean()
    norm = np.sqrt((t * t).sum())
    size = (image.shape[0] + th - 1, image.shape[1] + tw - 1)
    cross = np.fft.irfft2(np.fft.rfft2(image, size) * np.fft.rfft2(t[::-1, ::-1], size), size)[th - 1 : image.shape[0], tw - 1 : image.shape[1]]

    def window_sums(values: np.ndarray) -> np.ndarray:
        s = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
        s[1:, 1:] = values.cumsum(0).cumsum(1)
        return s[th:, tw:] - s[:-th, tw:] - s[th:, :-tw] + s[:-th, :-tw]

    spread = np.sqrt(np.maximum(window_sums(image * image) - window_sums(image) ** 2 / (th * tw), 0))
    bottom = spread * norm
    return np.where(bottom > 1e-6 * th * tw, cross / np.maximum(bottom, 1e-12), 0.0)


def peak(surface: np.ndarray, width: int, height: int) -> tuple[int, int, float, float]:
    """x, y, score and margin: how far the best place outside the peak's own footprint stays behind."""
    y, x = np.unravel_index(int(surface.argmax()), surface.shape)
    score = float(surface[y, x])
    rest = surface.copy()
    rest[max(0, y - height // 2) : y + height // 2 + 1, max(0, x - width // 2) : x + width // 2 + 1] = -1
    return int(x), int(y), score, score - float(rest.max())


def refined(image: np.ndarray, template: np.ndarray, x: float, y: float, margin: int) -> tuple[int, int, float, int]:
    """x, y and score of a template near a guess, and the pixels that were searched.

    Only a window of ``margin`` about the guess is correlated.  A peak at an edge of the window that is none of the
    image says that the guess was farther off: the margin is tripled until it isn't, or the window is the image.
    """
    h, w = template.shape
    spent = 0
    while True:
        left, top = max(0, min(int(x - margin), image.shape[1] - w)), max(0, min(int(y - margin), image.shape[0] - h))
        right, bottom = min(image.shape[1], int(x + w + margin) + 1), min(image.shape[0], int(y + h + margin) + 1)
        window = image[top : max(bottom, top + h), left : max(right, left + w)].astype(float)
        spent += window.size
        surface = correlation(window, template)
        py, px = np.unravel_index(int(surface.argmax()), surface.shape)
        at_edge = (
            (px < 2 and left > 0) or (py < 2 and top > 0)
            or (px > surface.shape[1] - 3 and left + window.shape[1] < image.shape[1]) or (py > surface.shape[0] - 3 and top + window.shape[0] < image.shape[0])
        )
        if not at_edge:
            return left + int(px), top + int(py), float(surface[py, px]), spent
        margin *= 3


def search(image: np.ndarray, part: np.ndarray, low: float, high: float) -> tuple[int, int, int, int, float, float, int]:
    """x, y, w, h, score and margin of a part in an image, and the scales that were tried.

    Coarse scales on a small copy, fine ones about the best; their peak is then refined in a window at full size.
    The margin is that of the small copy, where the whole surface is known.
    """
    long = max(image.shape)
    shrink = min(1.0, COARSE / long)
    small = resized(image, max(1, round(image.shape[1] * shrink)), max(1, round(image.shape[0] * shrink)))
    tries = 0

    def tried(scales) -> tuple[float, int, int, float]:
        nonlocal tries
        best, at = (False, -1.0), (float(scales[0]), 0, 0, 0.0)
        for s in scales:
            w, h = round(part.shape[1] * s * shrink), round(part.shape[0] * s * shrink)
            if 4 <= w <= small.shape[1] and 4 <= h <= small.shape[0]:
                tries += 1
                x, y, score, margin = peak(correlation(small, resized(part, w, h)), w, h)
                # a peak that stands clear beats a higher one that does not
                if (margin >= LEAST_MARGIN, score) > best:
                    best, at = (margin >= LEAST_MARGIN, score), (float(s), x, y, margin)
        return at

    if high > low:
        rough = tried(np.geomspace(low, high, COARSE_STEPS))[0]
        step = (high / low) ** (1 / (COARSE_STEPS - 1))
        fine, sx, sy, margin = tried(np.geomspace(rough / step, rough * step, FINE_STEPS))
    else:
        fine, sx, sy, margin = tried([low])
    found = (0, 0, 0, 0, -1.0, 0.0)
    for dw in (0, -1, 1) if high > low else (0,):
        w = round(part.shape[1] * fine) + dw
        h = round(part.shape[0] * w / part.shape[1])
        if 1 <= w <= image.shape[1] and 1 <= h <= image.shape[0]:
            tries += 1
            x, y, score, _ = refined(image, resized(part, w, h), sx / shrink, sy / shrink, max(8, int(long / COARSE) + 4))
            if score > found[4]:
                found = (x, y, w, h, score, margin)
    return *found, tries


def score_at(image: np.ndarray, part: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """The correlation of a part with one box of an image."""
    box = image[y : y + h, x : x + w].astype(float)
    return float(correlation(box, resized(part, w, h))[0, 0]) if box.shape == (h, w) else 0.0


def _pixels(data, width: int, height: int) -> np.ndarray:
    return np.frombuffer(bytes(data), np.uint8).reshape(height, width)


def located(overviews: DataFrame, parts: DataFrame, *, low: float = 1.0, high: float = 1.0) -> DataFrame:
    """sheet, part, x, y, w, h, score, margin, tries of every part (sheet, part, width, height, pixels) in its overview (sheet, width, height, pixels).

    ``low`` and ``high`` bound the scale of parts in the overview; columns of these names of the overviews do it for each.
    A pair that can't be searched gives score -1, never an error.
    """
    own = [F.col(c) if c in overviews.columns else F.lit(v).alias(c) for c, v in (("low", low), ("high", high))]
    o = overviews.select("sheet", F.col("width").alias("ow"), F.col("height").alias("oh"), F.col("pixels").alias("op"), *own)
    pairs = parts.select("sheet", F.col("part").cast("string").alias("part"), "width", "height", "pixels").join(o, "sheet")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    found = search(_pixels(r.op, r.ow, r.oh), _pixels(r.pixels, r.width, r.height), r.low, r.high)
                except ValueError:
                    found = (0, 0, 0, 0, -1.0, 0.0, 0)
                rows.append((r.sheet, r.part, *found))
            yield pd.DataFrame(rows, columns=["sheet", "part", "x", "y", "w", "h", "score", "margin", "tries"])

    return pairs.mapInPandas(run, HITS)


def located_by_family(overviews: DataFrame, parts: DataFrame, *, low: float, high: float) -> DataFrame:
    """``located`` over families of overviews (family, ord, sheet, width, height, pixels): the first sheet of a family, by ``ord``,
    with a sure hit tells the scale of all that follow, which are searched at that scale alone.

    Sheets before it, and families without one, are searched at all scales.  The first is found in rounds over twice as many
    sheets of each open family, so a family is no single task and at most about twice the sheets that a walk in order would
    search are searched in full; what lies behind the first is then searched again at its scale.
    """
    order = numbering.numbered(overviews.select("family", "ord", "sheet"), ["family"], ["ord", "sheet"], "rank")
    order = written(order.select("family", "sheet", "rank"), "family-order")
    sizes = parts.select("sheet", F.col("part").cast("string").alias("part"), F.col("width").alias("part_width"))
    spark, done, hints, first = overviews.sparkSession, None, None, 1
    most = order.agg(F.max("rank")).first()[0] or 0
    while first <= most:
        due = order.filter(F.col("rank").between(first, 2 * first - 1))
        due = due if hints is None else due.join(hints, "family", "left_anti")
        hits = written(located(overviews.join(due.select("sheet"), "sheet"), parts, low=low, high=high), "family-hits")
        done = hits if done is None else done.union(hits)
        sure = hits.filter(is_sure(F.col("score"), F.col("margin"))).join(order, "sheet").join(sizes, ["sheet", "part"])
        # of the first sheet's sure parts the best one's scale
        found = sure.groupBy("family").agg(F.min_by(F.struct("rank", (F.col("w") / F.col("part_width")).alias("scale")), F.struct("rank", -F.col("score"), "part")).alias("hint")).select("family", "hint.*")
        found = written(found, "family-hints")
        hints = found if hints is None else hints.union(found)
        first *= 2
    if done is None:
        return spark.createDataFrame([], HITS)
    behind = order.join(hints.withColumnRenamed("rank", "at"), "family").filter("rank > at").select("sheet", "scale")
    behind = written(behind, "family-rest")
    rest = located(overviews.drop("low", "high").join(behind.select("sheet", F.col("scale").alias("low"), F.col("scale").alias("high")), "sheet"), parts)
    return done.join(behind, "sheet", "left_anti").unionByName(rest)


def is_sure(score: Column, margin: Column) -> Column:
    return (score >= LEAST_SCORE) & (margin >= LEAST_MARGIN)


def best_of(hits: DataFrame) -> DataFrame:
    """The best hit of each sheet and part: clear peaks first, then the score."""
    order = guards.peak_order(F.col("score"), F.col("margin"), LEAST_MARGIN)
    return hits.groupBy("sheet", "part").agg(F.max_by(F.struct("x", "y", "w", "h", "score", "margin"), order).alias("b")).select("sheet", "part", "b.*")


def analysed(overviews: DataFrame, hits: DataFrame, width: int, height: int) -> DataFrame:
    """sheet, parts, sure, coverage, confident for every overview; a sheet without hits is not confident.

    Confident: all parts are sure and they cover the sheet, but for its flat margins.
    """
    found = best_of(hits)
    covered = geometry.union_area(found.filter(is_sure(F.col("score"), F.col("margin"))), "sheet", width, height)
    counts = found.groupBy("sheet").agg(F.count("*").alias("parts"), F.count_if(is_sure(F.col("score"), F.col("margin"))).alias("sure"))
    own = overviews.select("sheet").join(counts, "sheet", "left").join(covered, "sheet", "left")
    share = F.coalesce("area", F.lit(0)) / float(width * height)
    return own.select("sheet", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("sure", F.lit(0)).alias("sure"), share.alias("coverage"), (F.coalesce(F.col("parts") == F.col("sure"), F.lit(False)) & (share >= LEAST_COVERAGE)).alias("confident"))


def misnamed(hits: DataFrame, claims: DataFrame) -> DataFrame:
    """sheet, part, other: parts that are not sure in the sheet that claims them (part, sheet) and sure in another, the best of these."""
    found = best_of(hits).withColumn("sure", is_sure(F.col("score"), F.col("margin")))
    own = claims.select("part", F.col("sheet").alias("claimed")).join(found, "part")
    weak = own.filter("sheet = claimed AND NOT sure").select("part", "claimed")
    other = own.filter("sheet <> claimed AND sure").groupBy("part", "claimed").agg(F.max_by("sheet", "score").alias("other"))
    return weak.join(other, ["part", "claimed"]).select(F.col("claimed").alias("sheet"), "part", "other")


def recreation(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """sheet, cell, x, y, w, h, sibling: cells (sheet, cell, cell_index, x, y, w, h) near which no part is, with the sibling to copy names from."""
    found = best_of(hits).filter(is_sure(F.col("score"), F.col("margin")))
    gone = geometry.missing_cells(cells, found, "sheet")
    order = found.join(cells.select("sheet", "cell_index", F.col("x").alias("cx"), F.col("y").alias("cy")), "sheet").filter((F.abs(F.col("x") - F.col("cx")) <= 2) & (F.abs(F.col("y") - F.col("cy")) <= 2))
    siblings = geometry.nearest_sibling(gone.select("sheet", "cell", "cell_index"), order.select("sheet", "part", F.col("cell_index").alias("part_index"), F.col("part").alias("part_order")), "sheet")
    return gone.join(siblings, ["sheet", "cell"], "left")
