"""Refinement in a window and scales that families hand on."""

import numpy as np
import pytest

from foliant.operators import locate


def textured(rng, height, width):
    return locate.resized(rng.integers(0, 256, (height // 4 + 2, width // 4 + 2)).astype(float), width, height).round().astype(np.uint8)


@pytest.mark.parametrize("seed", range(4))
def test_a_window_finds_what_the_whole_image_shows(seed):
    rng = np.random.default_rng(seed)
    image = textured(rng, 700, 900)
    w, h = int(rng.integers(60, 140)), int(rng.integers(60, 140))
    x, y = int(rng.integers(0, 900 - w)), int(rng.integers(0, 700 - h))
    template = image[y : y + h, x : x + w].astype(float)
    px, py, score, _ = locate.peak(locate.correlation(image.astype(float), template), w, h)
    found = locate.refined(image, template, x + rng.integers(-6, 7), y + rng.integers(-6, 7), 8)
    assert (found[0], found[1]) == (px, py) == (x, y) and found[2] == pytest.approx(score)
    assert found[3] <= (w + 50) * (h + 50) * 2 < image.size / 4  # the cost follows the window


def test_a_far_guess_widens_the_window():
    rng = np.random.default_rng(9)
    image = textured(rng, 400, 500)
    template = image[300:360, 400:470].astype(float)
    near = locate.refined(image, template, 399, 301, 8)
    far = locate.refined(image, template, 390, 300, 8)
    assert near[:2] == far[:2] == (400, 300) and near[2] == pytest.approx(far[2]) and far[2] > 0.999
    assert near[3] < far[3] < image.size


def test_search_at_a_scale(spark):
    rng = np.random.default_rng(3)
    image = textured(rng, 420, 600)
    big = locate.resized(image[200:300, 250:400], 300, 200).round().astype(np.uint8)
    x, y, w, h, score, margin, tries = locate.search(image, big, 0.25, 1.0)
    assert abs(x - 250) <= 2 and abs(y - 200) <= 2 and abs(w - 150) <= 3 and score > 0.9 and tries > 10


def test_families_hand_on_their_scale(spark):
    """The second sheet of a family is the first that is sure; what follows it is tried at its scale alone, and finds the same."""
    rng = np.random.default_rng(12)
    sheets, pieces = [], []
    for family in ("a", "b"):
        for n in range(5):
            image = textured(rng, 160, 190)
            piece = image[40:100, 60:140] if n else textured(rng, 60, 80)  # the first sheet's part is not on it
            grown = locate.resized(piece, 160, 120).round().astype(np.uint8)
            name = f"{family}{n}"
            sheets.append((family, n, name, 190, 160, bytearray(image.tobytes())))
            pieces.append((name, "p", 160, 120, bytearray(grown.tobytes())))
    o = spark.createDataFrame(sheets, "family string, ord int, sheet string, width int, height int, pixels binary")
    p = spark.createDataFrame(pieces, "sheet string, part string, width int, height int, pixels binary")
    full = {r.sheet: r for r in locate.located(o, p, low=0.3, high=0.9).collect()}
    told = {r.sheet: r for r in locate.located_by_family(o, p, low=0.3, high=0.9).collect()}
    assert told.keys() == full.keys()
    for sheet, r in told.items():
        if sheet[1] == "0":
            assert r.score < 0.9 and r.tries == full[sheet].tries
        else:
            assert r.score > 0.9 and abs(r.x - 60) <= 2 and abs(r.y - 40) <= 2 and abs(r.x - full[sheet].x) <= 2
            assert r.tries == (full[sheet].tries if sheet[1] == "1" else 2)
    assert sum(r.tries for r in told.values()) < 0.5 * sum(r.tries for r in full.values())
    assert locate.located_by_family(o.limit(0), p, low=0.3, high=0.9).count() == 0
