"""Divergence audit: how far the sources of a language are apart in the terms they use, and which terms make it.

A first pass counts the documents of each (language, term) in a count-min sketch: every task sketches its
rows, the sketches are added, and a term whose least cell stays below the threshold is in too few documents
whatever collides with it.  A second pass counts the other terms exactly; only those are shuffled.  Sums over all
terms of a pair of sources come from the terms that both have (a sparse join) and from each source's own terms
against the other's smallest share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.tables import sized

from .common import map_arrow, written

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Ranks of the terms that are reported for a group.
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Rows of the sketch and cells of a row.  More frequent terms than cells make it useless, not wrong.
DEPTH, WIDTH = 3, 1 << 21
#: Letters: A to Z as a to z, bytes of other than ASCII characters as they are; anything else parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(terms: pa.StringArray) -> np.ndarray:
    """64-bit hashes of the terms, a polynomial of the bytes; those of empty ones mean nothing."""
    data = terms.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
    if len(data) == 0:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    starts = ends[:-1] - ends[0]
    place = np.arange(len(text)) - np.repeat(starts, np.diff(ends))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _GOLDEN, np.uint64), dtype=np.uint64)
    # one number more, since the last term may be empty
    return mixed(np.add.reduceat(np.append(text * power[place], np.uint64(0)), starts) + np.diff(ends).astype(np.uint64))


def cells(langs: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Cells (DEPTH, n) of the sketch for hashes of languages and of terms; one hash gives the place in every row."""
    both = mixed(langs * np.uint64(_GOLDEN) ^ terms)
    step = (both >> np.uint64(32)) | np.uint64(1)
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    return (((both + rows * step) % np.uint64(WIDTH)) + rows * np.uint64(WIDTH)).astype(np.int64)


def term_lists(texts: pa.StringArray) -> pa.ListArray:
    """The terms of each text, in order."""
    _, offsets, data = texts.buffers()
    spaced = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERM_BYTES)), None, 0, texts.offset)
    return pc.ascii_split_whitespace(spaced)


def counted(part: pa.RecordBatch, by: list[str]) -> Iterator[tuple]:
    """Group values, terms, and for each pair of them that occurs its group, its term (as indices), occurrences and documents."""
    lists = term_lists(part["text"])
    coded = lists.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(terms, "").as_py()
    many = max(1, len(terms))
    docs = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    if blank >= 0:
        docs, codes = docs[codes != blank], codes[codes != blank]
    keys = pa.StructArray.from_arrays([part[c] for c in by], by).to_pylist()
    found: dict[tuple, int] = {}
    group = np.array([found.setdefault(tuple(k.values()), len(found)) for k in keys], np.int64)
    pairs, times = np.unique(docs * many + codes, return_counts=True)
    owner = group[pairs // many] * many + pairs % many
    order = np.argsort(owner, kind="stable")
    owner, times = owner[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    seen = np.add.reduceat(times, first) if len(first) else times
    return list(found), terms, owner[first] // many, owner[first] % many, seen, np.diff(np.append(first, len(owner)))


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return hashed(pa.array([lang + "." for lang in langs], pa.string()))


def sketch(texts: DataFrame) -> DataFrame:
    """cell, n: documents of each (language, term), added up over all tasks; ``texts`` has lang and text."""

    def make():
        total = np.zeros(DEPTH * WIDTH, np.int32)

        def step(part):
            if part is not None:
                langs, terms, lang, term, _, docs = counted(part, ["lang"])
                if len(term):
                    at = cells(_lang_hashes([k[0] for k in langs])[lang], hashed(terms)[term])
                    np.add.at(total, at.ravel(), np.tile(docs, DEPTH))
                return
            used = np.flatnonzero(total)
            for k in range(0, len(used), 1 << 18):
                yield {"cell": pa.array(used[k : k + (1 << 18)]), "n": pa.array(total[used[k : k + (1 << 18)]].astype(np.int64))}

        return step

    return map_arrow(texts, make, "cell bigint, n bigint", closing=True).groupBy("cell").agg(F.sum("n").alias("n"))


def full_cells(sums: DataFrame, least: int) -> bytes:
    """A bit for each cell that reached ``least``: DEPTH * WIDTH bits (768 KB) whatever the input, so every task can have them."""
    bit = F.col("cell") + 1
    maps = sums.filter(F.col("n") >= least).groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(DEPTH * WIDTH // 8, np.uint8)
    for row in maps:
        start = (row["at"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def survivors(texts: DataFrame, full: bytes) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, exact, of the terms that the sketch leaves; ``texts`` has lang, source, text."""
    shared = texts.sparkSession.sparkContext.broadcast(full)

    def make():
        bits = np.frombuffer(shared.value, np.uint8)

        def step(part):
            groups, terms, group, term, seen, docs = counted(part, ["lang", "source"])
            if not len(term):
                return
            at = cells(_lang_hashes([k[0] for k in groups])[group], hashed(terms)[term])
            left = np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0))
            names = [pa.array([k[n] for k in groups], pa.string()) for n in (0, 1)]
            yield {"lang": names[0].take(pa.array(group[left])), "source": names[1].take(pa.array(group[left])), "term": terms.take(pa.array(term[left])), "n": pa.array(seen[left]), "docs": pa.array(docs[left])}

        return step

    found = map_arrow(texts, make, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)); decimals keep the product exact."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20,0)) * {UNIT}) div CAST({total} + 2 * {kept} AS DECIMAL(20,0))")


def distance(p: str, q: str) -> str:
    """floor((p - q) ** 2 / (p + q)); shares stay below 2 ** 31, so the square fits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n of the terms in at least ``least`` documents of their language; ``docs`` has lang, source, text."""
    full = full_cells(sketch(docs.select("lang", "text")), least)
    counts = written(survivors(docs, full), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least).drop("docs")
    return written(counts.drop("docs").join(terms, ["lang", "term"]), "kept-terms")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) its distance to each other source of the
    language (part ``pair``, all ranks) and the terms it uses more than the language does (part ``term``, ``top`` ranks).

    Null texts, languages and sources are empty strings.  Ties go by the item's bytes.  A language without kept
    terms gives distances of 0, one with a single source no pairs; no documents give no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_counts(read, least)
    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.count("*").alias("own"), F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "total", "v", "lang_total"])
    groups = sized(written(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v"))), "term-groups"))
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v")).withColumn("q", share("lang_n", "lang_total", "v"))
    shares = written(shares.select("lang", "source", "term", "p", "q", "p0"), "term-shares")
    return _pairs(shares, groups).unionByName(_terms(shares, top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda frame, n, *names: frame.select("lang", *[F.col(c).alias(f"{c}{n}") for c in names])
    one, two = side(shares.withColumnRenamed("term", "t"), 1, "source", "p", "p0", "t"), side(shares.withColumnRenamed("term", "t"), 2, "source", "p", "p0", "t")
    # what a term that both have adds to the sums of either's own terms against the other's least share
    more = F.expr(f"{distance('p1', 'p2')} - {distance('p1', 'p02')} - {distance('p01', 'p2')} + {distance('p01', 'p02')}")
    met = one.join(two, (one["lang"] == two["lang"]) & (F.col("t1") == F.col("t2")) & (F.col("source1") < F.col("source2")))
    both = met.groupBy(one["lang"], "source1", "source2").agg(F.sum(more).alias("more"), F.count("*").alias("met"))
    both = both.unionByName(both.select("lang", F.col("source2").alias("source1"), F.col("source1").alias("source2"), "more", "met"))
    # terms of one share count alike
    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    other = side(groups, 2, "source", "p0")
    alone = steps.join(other, "lang").filter("source <> source2").groupBy("lang", F.col("source").alias("source1"), "source2").agg(F.sum(F.col("many") * F.expr(distance("p", "p02"))).alias("alone"))
    every = side(groups, 1, "source", "p0", "own", "v").join(side(groups, 2, "source", "p0", "own"), "lang").filter("source1 <> source2")
    whole = (
        every.join(both, ["lang", "source1", "source2"], "left").join(alone, ["lang", "source1", "source2"], "left")
        .join(alone.select("lang", F.col("source2").alias("source1"), F.col("source1").alias("source2"), F.col("alone").alias("back")), ["lang", "source1", "source2"], "left")
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.coalesce((F.col("v1") - F.col("own1") - F.col("own2")) * F.expr(distance("p01", "p02")), F.lit(0))
    value = none("more") + none("alone") + none("back") + rest
    rows = whole.select("lang", F.col("source1").alias("source"), F.lit("pair").alias("part"), F.col("source2").alias("item"), value.cast("bigint").alias("value"))
    return _ranked(rows)


def _terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
