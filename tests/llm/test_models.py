"""Media round trips, trained scores on held-out folds, the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ctw, files, media, quality, queries, toxicity

SMALL = "/root/testdata/sf0.001"


def table(spark, sf_dir, name):
    return {tuple(r)[0]: r for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()}


def test_media_of_whole_table(spark, sf_dir):
    texts = {d: r.text for d, r in table(spark, sf_dir, "documents").items()}
    rows = queries.op4_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    by_text = defaultdict(set)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_text[texts[r.doc_id]].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_media_edges_and_headers(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 5000), (4, "é" * 5000), (None, "x")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, length int")
    manifest = media.store(frame)
    heads = sorted((r.doc_id or 0, r.width, r.height, r.bit_depth) for r in media.header_columns(manifest).collect())
    assert heads == [(0, 64, 1, 8), (1, 64, 1, 8), (2, 64, 1, 8), (3, 64, 1, 8), (4, 64, 157, 8), (4, 64, 157, 8)]
    assert media.read_back(manifest).count() == 6
    place = {r.doc_id: (r.shard, r.offset) for r in manifest.filter("doc_id IN (1, 2)").collect()}
    assert len({p for p in place.values()}) <= 2
    assert media.media_columns(frame.limit(0)).count() == 0


def test_shards_are_tar_files_of_png_images(spark, tmp_path):
    import io
    import tarfile

    frame = spark.createDataFrame([(1, "hello"), (2, "world"), (3, "hello")], "doc_id bigint, text string").coalesce(1)
    rows = media.store(frame).collect()
    system, name = files.resolve(rows[0].shard)
    with tarfile.open(fileobj=io.BytesIO(system.open_input_file(name).read())) as t:
        members = {m.name: t.extractfile(m).read() for m in t.getmembers()}
    assert len(members) == 2 and set(members) == {f"{r.digest}.png" for r in rows}
    assert {media.from_png(b).rstrip(b"\0") for b in members.values()} == {b"hello", b"world"}
    broken = bytearray(next(iter(members.values())))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def plain_ctw(texts, trained, depth):
    """Context-tree weighting by the book: a dictionary of nodes, bit by bit."""
    nodes = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    steps = lambda x, i: [((1 << b) | (x[i] >> (8 - b)), (x[i] >> (7 - b)) & 1) for b in range(8)]
    for t, own in zip(texts, trained):
        x = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(x)) if own else ():
            for d in range(depth + 1):
                for prefix, bit in steps(x, i):
                    nodes[d][x[i - d : i], prefix][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, below = [{} for _ in range(depth + 1)], defaultdict(float)
    for d in range(depth, -1, -1):
        up = defaultdict(float)
        for (context, prefix), (a, b) in nodes[d].items():
            w = kt(a, b) if d == depth else float(np.logaddexp(kt(a, b), below[context, prefix]) - math.log(2))
            weighted[d][context, prefix] = w
            if d:
                up[context[1:], prefix] += w
        below = up

    def bit_probability(x, i, prefix, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            key = (x[i - d : i], prefix)
            a, b = nodes[d].get(key, (0, 0))
            own = ((a, b)[bit] + 0.5) / (a + b + 1)
            share = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted[d].get(key, 0.0)) if key in weighted[d] else 0.5
            p = share * own + (1 - share) * p
        return p

    out = []
    for t in texts:
        x = b"\xff" * depth + t + b"\xff"
        out.append(sum(math.log10(bit_probability(x, i, *s)) for i in range(depth, len(x)) for s in steps(x, i)))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, ctw.DEPTH])
def test_context_tree_against_the_book(spark, depth, monkeypatch):
    monkeypatch.setattr(ctw, "BATCH_BYTES", 30)  # several batches in a task
    monkeypatch.setattr(ctw, "CHUNK_ROWS", 7)
    monkeypatch.setattr(ctw, "BUCKETS", (3, 3))
    texts = ["abracadabra", "ABRA kadabra abra", "", None, "the cat the cat the hat", "é è é"]
    rows = [(n, t, "x") for n, t in enumerate(texts * 2)] + [(None, "abra", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = ctw.score(frame, modulus=3, held_out=1, depth=depth).collect()
    assert len(got) == len(rows)
    fold = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    data = [(t or "").encode().lower() for _, t, _ in rows]
    want = dict(zip([(d, t) for d, t, _ in rows], plain_ctw(data, [not fold(d) for d, _, _ in rows], depth)))
    by_id = {d: t for d, t, _ in rows}
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id, by_id[r.doc_id]], rel=1e-5, abs=1e-5)
        assert r.held_out == fold(r.doc_id) and r.n_coded == len((by_id[r.doc_id] or "").encode()) + 1
    assert ctw.score(frame.limit(0)).count() == 0


def test_long_texts_in_units(monkeypatch):
    texts = [b"hello world " * 50, b"", b"abc"]
    whole = np.concatenate([ctw._chosen(*ctw._grams(u, 5)) for u in ctw._units(texts, 5)])
    parts = np.concatenate([ctw._chosen(*ctw._grams(u, 5)) for u in ctw._units(texts, 5, 17)])
    assert np.array_equal(whole, parts) and len(whole) == sum(map(len, texts)) + 3


def test_unigram_base_of_whole_table(spark, sf_dir):
    texts = {d: r.text.encode().lower().split() + [b""] for d, r in table(spark, sf_dir, "documents").items()}
    own = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in texts}
    c = Counter(w for d, ws in texts.items() if own[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.op8_lm_scores(spark, sf_dir).collect()
    for r in rows:
        ws = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_coded for r in held) * -math.log2(10) < 3.5


def accuracy(spark, sf_dir, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + 0.5 * (a == b) for a, _, x in held if x for b, _, y in held if not y]
    return sum(p == y for _, p, y in held) / len(held), sum(pairs) / len(pairs)


def test_quality_on_the_held_out_fold(spark):
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").collect()
    right, auc = accuracy(spark, "/root/testdata/sf0.01", rows, "quality")
    assert right > 0.9 and auc > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (3, "x " * 50_000, 3.0)], "doc_id bigint, text string, score double")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd.limit(0), model).count() == 0
    good = sorted(r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect())
    assert 0 < len(good) < docs.count() and sorted(r.doc_id for r in quality.keep_good(docs, model).collect()) == good
    assert quality.keep_good(odd, model, threshold=0.0).exceptAll(odd).count() == 0 and quality.keep_good(odd, model, threshold=0.0).count() == 4
    assert quality.keep_good(odd.limit(0), model).count() == 0
    twice = odd.select("text", F.col("doc_id").alias("n"), F.col("score").alias("n"))
    assert quality.keep_good(twice, model, threshold=0.0).columns == twice.columns
    assert quality.train(docs.limit(0), labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] >= 0.7
    assert 0.6 < quality.estimate_prior(np.random.default_rng(1).normal(3, 1, (800, 4)), np.random.default_rng(2).normal(3, 1, (800, 4))) <= 0.99


def test_prior_estimate():
    """Mixtures of known share, and the non-negative risk's gradient by differences."""
    draw = np.random.default_rng(3)
    good, bad = lambda n: draw.normal(0, 1, (n, 4)), lambda n: draw.normal(2.5, 1, (n, 4))
    for share in (0.3, 0.6, 0.9):
        n = int(6000 * share)
        found = quality.estimate_prior(good(2000), np.concatenate([good(n), bad(6000 - n)]))
        assert abs(found - share) < 0.05, (share, found)


def test_risk_has_the_known_minimum():
    """One feature of two values: the risk's minimum has a closed form, the odds of a good document in each."""
    positive = np.repeat([[0.0], [1.0]], [900, 100], axis=0)
    unlabelled = np.repeat([[0.0], [1.0]], [500, 500], axis=0)
    model = quality._fit(positive, unlabelled, 0.5, steps=6000, l2=0.0)
    # of the unlabelled half 0.5 * 0.9 / 0.5 of value 0 are good and 0.5 * 0.1 / 0.5 of value 1
    assert model.score(np.array([[0.0], [1.0]])) == pytest.approx([0.9, 0.1], abs=0.02)


def test_toxicity_on_the_held_out_fold(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    right, auc = accuracy(spark, sf_dir, toxicity.score(docs, model).collect(), "toxic")
    assert right > 0.9 and auc > 0.85
    for written in ("m0r0n", "m.o.r.o.n", "mooooron", "id10t", "tr@sh", "l-o-s-e-r"):
        plain = {"m0r0n": "moron", "m.o.r.o.n": "moron", "mooooron": "moron", "id10t": "idiot", "tr@sh": "trash", "l-o-s-e-r": "loser"}[written]
        assert plain in model.restored(written)
    assert toxicity.tokens_of("you i d i o t there a b") == ["you", "i d i o t", "there", "a", "b"]
    for written, plain in (("i d i o t", "idiot"), ("a m o r o n", "moron"), ("m 0 r 0 n", "moron")):
        assert plain in model.restored(written), (written, model.restored(written))
    assert len(model.restored("m0ron" * 20_000)) >= 1  # whole, whatever its length
    odd = spark.createDataFrame([(None, None, 1), (2, "", 1), (2, "", 1)], "doc_id bigint, text string, held_out int")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 3 and all(r.predicted == 0 for r in rows)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0)).score("any") == 0.5


def test_decoder_against_all_paths():
    """Viterbi against the enumeration of every reading of short tokens."""
    model = toxicity.CharacterModel.learned(toxicity.trigrams("the moron is an idiot and a loser in a trash can lol " * 3))

    def paths(token, place=0, text="", cost=0.0):
        if place == len(token):
            yield cost + model.text_cost(text), text
            return
        c = token[place]
        readings, dropped = toxicity.options(c, place + 1 == len(token))
        for letter, change in readings:
            yield from paths(token, place + 1, text + letter, cost + change)
            if letter != " " and letter == text[-1:] and (c.isalpha() or change > 0):
                yield from paths(token, place + 1, text, cost + toxicity.REPEATED + change)
        if dropped is not None:
            yield from paths(token, place + 1, text, cost + dropped)

    for token in ("m0r0n", "1d10t", "l.o.s3r!", "moooron", "a m o r", "l0 l", "tr@5h", "x", "$", "1 2 a", "lo-ser.", "i  d"):
        every = sorted(paths(token))
        best = toxicity.restore(token, model)[0]
        assert min(c for c, t in every if t == best) == pytest.approx(every[0][0]), token


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    from foliant.llm import decontaminate, near_text, secrets

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "near duplicates":
            groups = {r.id: r.group_id for r in near_text.groups(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, g in groups.items() if i == g}
        if name == "benchmark decontamination":
            leaks = {r.doc_id for r in decontaminate.overlaps(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaks
        if name == "secret scans":
            assert docs.count() == before.count()
            assert not [r for r in secrets.scan(docs).collect() if r.spans]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert corpus_pipeline.run(spark, SMALL).count() == kept["byte-level BPE"]


def test_pipeline_over_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, columns named like the stages' own; then no documents at all."""
    import corpus_pipeline

    good = "The quick brown fox jumps over the lazy dog near the river bank. " * 6
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, None, "en", None, None), (3, "", None, "s", 0), (None, good + "other words", "en", "s", 9), (None, None, None, None, None), (4, "x" * 60_000, "en", "s", 60_000)]
    wide = [(*r, 1.5, 7, "w", [1], 2) for r in rows]
    docs = spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp int, words string, bands array<int>, id int")
    for name, frame in (("odd", docs), ("none", docs.limit(0))):
        at = str(tmp_path / name)
        frame.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "some words that no document holds in this order at all really not one"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at)
        ids = [r.doc_id for r in got.collect()]
        assert got.columns[:2] == ["doc_id", "n_tokens"]
        assert len([i for i in ids if i == 1]) <= 1 and set(ids) <= {1, 2, 3, 4, None}
        if name == "none":
            assert ids == []
        else:
            assert 1 in ids
