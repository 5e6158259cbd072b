"""Lattice near duplicates, divergence audit and Merkle manifest against brute force."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from foliant.llm import divergence, lattice, merkle

# lattice


def linked(rows, limit=0.98):
    """(vec_id, links, component) of each row, by all pairs."""
    usable = lambda e: bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    spaces = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and usable(e):
            spaces.setdefault((label, len(e)), []).append(k)
    for members in spaces.values():
        x = np.array([rows[k][1] for k in members], float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= limit
        for a, k in enumerate(members):
            links[k] = int(near[a].sum()) - 1
            for b in np.flatnonzero(near[a, :a]):
                root[find(k)] = find(members[b])
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [(i, links[k], None if i is None else min(groups[find(k)])) for k, (i, _, _) in enumerate(rows)]


def found(frame):
    return sorted((tuple(r)[:3] for r in lattice.near_duplicates(frame).collect()), key=repr)


def test_decode_is_the_nearest_point():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(300, 8)) * 2
    home = lattice.decode(y)
    around = home[:, None] + np.concatenate([lattice.minimal_vectors(), [v for v in np.vstack([np.eye(8) * 2, -np.eye(8) * 2])]])
    assert (((y[:, None] - around) ** 2).sum(2).min(1) >= ((y - home) ** 2).sum(1) - 1e-12).all()
    assert (np.mod(home.sum(1), 2) < 1e-9).all() and (np.isclose(np.mod(home, 1), np.mod(home[:, :1], 1))).all()


def test_odd_vectors(spark):
    one, near = [1.0] + [0.0] * 7, [1.0, 0.01] + [0.0] * 6
    rows = [
        (1, one, 1), (2, one, 1), (3, near, 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0] * 8, 1), (8, [float("nan")] + one[1:], 1),
        (9, [None] + one[1:], 1), (10, [], 1), (11, one[:4], 1), (12, near[:4], 1), (13, [1e30] + [0.0] * 7, 1), (14, [-1.0] + [-0.0] * 7, 1),
        (15, [float("inf")] + one[1:], 1), (None, one, 1), (16, one, 1), (16, near, 1), (17, [3.0], 3), (18, [5.0], 3), (19, [-5.0], 3),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, cell string")
    want = linked(rows)
    # an id that repeats is one node of the components
    want = [(i, n, 1 if i == 16 else c) for i, n, c in want]
    assert found(frame) == sorted(want, key=repr)
    kept = {(r.vec_id, r.kept) for r in lattice.near_duplicates(frame).collect()}
    assert (1, True) in kept and (2, False) in kept and (5, True) in kept and (None, False) in kept
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_limit_and_nothing_below(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(1500, 48)))
    off = rng.normal(size=base.shape)
    off = unit(off - (off * base).sum(1)[:, None] * base)
    cos = np.linspace(0.97, 0.9999, len(base))[:, None]
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * off])
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(both)]
    got = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    want = sorted(linked(rows), key=repr)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


@pytest.mark.parametrize("spread", [0.002, 0.02])
def test_crowded_groups_in_blocks(spark, monkeypatch, spread):
    """Tight groups are balls; wide ones are compared in blocks; both against all pairs."""
    monkeypatch.setattr(lattice, "BLOCK", 40)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(1, 32))
    x = np.concatenate([centre + spread * np.abs(centre).mean() * k * rng.normal(size=(150, 32)) for k in (1, 4)] + [rng.normal(size=(100, 32))])
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")), sorted(linked(rows), key=repr)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) and sum(w[1] for w in want) > 20_000
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(rows)


# divergence


def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    counts, docs, out = {}, {}, []
    for lang, source, text in rows:
        words = term.findall((text or "").translate(low))
        counts.setdefault((lang or "", source or ""), Counter()).update(words)
        docs.setdefault(lang or "", Counter()).update(set(words))
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for name, s in counts if name == lang]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, n + 1) for part, found in (("pair", pairs), ("term", terms)) for n, (v, _, item) in enumerate(found)]
    return sorted(out)


ODD_TEXTS = [
    (None, "a", None, 1), ("", "b", "x Y z" * 3, 2), ("de", None, "Äpfel äpfel ÄPFEL " * 20, 3), ("de", "b", "", 4), ("de", "c", "1 2 3 äpfel-BAUM_x y", 5), ("de", "c", "1 2 3 äpfel-BAUM_x y", 5),
    ("fr", "a", "W" * 70_000 + " mot " * 30_000, 6), ("fr", "b", "mot　mot\x00MOT \U0001f600 mot", 7), ("fr", "c", "rien", None), ("it", "a", "solo", 9), ("it", "b", " \t ", 9),
]


@pytest.mark.parametrize("least, top", [(1, 2), (2, 10), (50, 3)])
def test_audit_of_odd_texts(spark, least, top):
    frame = spark.createDataFrame(ODD_TEXTS, "lang string, source string, text string, p0 bigint")
    assert sorted(tuple(r) for r in divergence.audit(frame, least, top).collect()) == audited([r[:3] for r in ODD_TEXTS], least, top)


def test_audit_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in divergence.audit(docs, 3, 5).collect()) == audited(rows, 3, 5)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sketch_never_underestimates_and_discards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text")
    full = divergence.full_cells(divergence.sketch(docs.select("lang", "text")), 10)
    left = {(r.lang, r.term) for r in divergence.survivors(docs, full).select("lang", "term").collect()}
    exact = {}
    for r in docs.collect():
        text = r.text.encode().translate(divergence._TERM_BYTES).decode()
        exact.setdefault(r.lang, Counter()).update(set(text.split()))
    frequent = {(lang, t) for lang, found in exact.items() for t, n in found.items() if n >= 10}
    assert frequent <= left and len(left - frequent) <= 0.001 * sum(map(len, exact.values()))


def test_shares_of_huge_counts(spark):
    got = spark.sql("SELECT 40000000000000L AS n, 90000000000000L AS total, 3000000000L AS v").select(divergence.share("n", "total", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (40_000_000_000_000 + 2) // (90_000_000_000_000 + 6_000_000_000)


# manifest


def digest(text):
    return sha256(text.encode()).hexdigest()


def levels(leaves, fanout=8):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def up(found, at, fanout=8):
    for level in found[:-1]:
        first = at - at % fanout
        yield "".join(level[first:at]), "".join(level[at + 1 : first + fanout])
        at //= fanout


def manifested(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text), one document after the other."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(map(part, (*r[:4], text))))
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for v in langs}
    trees = {v: levels([leaf(r, r[4]) for r in groups[v]]) for v in langs}
    crown, out = levels([trees[v][-1][0] for v in langs]), []
    for n, lang in enumerate(langs):
        for k, r in enumerate(groups[lang]):
            path = [*up(trees[lang], k), *up(crown, n)]
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if changed else r[4])
            for a, b in path:
                node = digest(a + node + b)
            out.append((r[0], trees[lang][0][k], trees[lang][-1][0], crown[-1][0], digest("".join(a + b for a, b in path)), node, node == crown[-1][0], lang, k))
    return sorted(out, key=repr)


DOC = "doc_id bigint, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_of_the_documents(spark, sf_dir, height):
    """Blocks of 8, 64 and 4096 leaves: several tiers give the tree that one gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = merkle.manifest(docs, height=height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifested(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(k, "s", f"l{k}", 1, "T") for k in range(9)] + [(None, None, None, None, None), (None, None, None, None, "-"), (5, "a", "", 2, ""), (5, "a", "", 2, ""), (5, "b", "", 2, "Ä" * 70_000)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC + ", grp string, at int, digest string")
    assert sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=repr) == manifested(rows)
    assert merkle.manifest(frame.limit(0)).count() == 0
    lone = merkle.manifest(frame.filter("doc_id = 3")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == digest("")


def test_null_and_dash_differ(spark):
    rows = [(1, None, "x", 1, "t"), (1, "-", "x", 1, "t"), (1, "1:-", "x", 1, "t")]
    assert len({r.leaf for r in merkle.manifest(spark.createDataFrame(rows, DOC)).collect()}) == 3
