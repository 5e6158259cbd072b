"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from .decontaminate import LEAST_WORDS
from .licenses import SHINGLE, TEMPLATES

GAP = r"'[\x20\x09-\x0D]+'"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(text: str) -> str:
    return f"string_split_regex(trim(lower(coalesce({text}, '')), {BLANK}), {GAP})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Every window of every class, without MinHash: exact containment of what it holds.
LICENSES = f"""
WITH t(template_id, license, text) AS (VALUES {", ".join(f"({n}, {_quoted(a)}, {_quoted(b)})" for n, (a, b) in enumerate(TEMPLATES))}),
tw AS (SELECT template_id, {_words("text")} AS w FROM t),
ts AS (SELECT DISTINCT template_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM tw, range(1, 3000) r(i) WHERE i + {SHINGLE - 1} <= len(w)),
tc AS (SELECT template_id, count(*) AS n, CAST(ceil(log2(count(*))) AS INT) AS cls FROM ts GROUP BY template_id),
d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 1))) AS i)),
h AS (SELECT * FROM p WHERE g IN (SELECT g FROM ts)),
win AS (SELECT DISTINCT doc_id, cls, pos // (1 << cls) - k AS place, g FROM h, (SELECT DISTINCT cls FROM tc), (VALUES (0), (1)) v(k) WHERE pos // (1 << cls) >= k),
hit AS (SELECT doc_id, win.cls, place, template_id, count(*) AS shared FROM win JOIN ts USING (g) JOIN tc USING (template_id) WHERE tc.cls = win.cls GROUP BY ALL)
SELECT doc_id, template_id, license, max(shared / n) AS containment, count(*) AS n_windows FROM hit JOIN tc USING (template_id) JOIN t USING (template_id) WHERE shared / n >= 0.8 - 1e-9 GROUP BY ALL
"""

#: Alignments from runs of equal words: with d of n words unequal some run has the (d + 1)-th part of the equal ones (four of a window of 13).
LEAKS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b0 AS (SELECT item_id, {_words("text")} AS w, least(13, len(w)) AS n, CAST(ceil(n * 0.8 - 1e-9) AS INT) AS eq FROM benchmark WHERE trim(coalesce(text, ''), {BLANK}) <> '' AND len(w) >= {LEAST_WORDS}),
b AS (SELECT item_id, w, CAST(ceil(eq / (n - eq + 1)) AS INT) AS run FROM b0),
dp AS (SELECT doc_id, run, i - 1 AS pos, array_to_string(w[i:i + run - 1], ' ') AS g FROM d, (SELECT DISTINCT run FROM b) r, LATERAL (SELECT unnest(range(1, greatest(len(w) - run + 2, 1))) AS i)),
bp AS (SELECT item_id, run, i - 1 AS pos, array_to_string(w[i:i + run - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - run + 2, 1))) AS i)),
s AS (SELECT DISTINCT doc_id, item_id, dp.pos - bp.pos AS shift FROM dp JOIN bp USING (run, g)),
e AS (SELECT doc_id, item_id, shift, len(b.w) AS n, list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN i + shift BETWEEN 1 AND len(d.w) AND d.w[i + shift] = b.w[i] THEN 1 ELSE 0 END) AS eq FROM s JOIN d USING (doc_id) JOIN b USING (item_id)),
st AS (SELECT doc_id, item_id, shift, n, list_sum(eq) AS total, k, list_sum(eq[k + 1:k + least(13, n)]) AS part FROM e, LATERAL (SELECT unnest(range(0, n - least(13, n) + 1)) AS k)),
best AS (SELECT doc_id, item_id, shift, any_value(n) AS n, any_value(total) AS total, max(part) AS part, arg_max(k, (part, -k)) AS k FROM st GROUP BY doc_id, item_id, shift HAVING max(part) >= ceil(least(13, any_value(n)) * 0.8 - 1e-9))
SELECT doc_id, item_id, CAST(arg_max(shift + k, (total, part, -shift)) AS INT) AS doc_start, CAST(arg_max(k, (total, part, -shift)) AS INT) AS item_start, CAST(arg_max(n, (total, part, -shift)) AS INT) AS n_aligned, CAST(arg_max(total, (total, part, -shift)) AS INT) AS n_equal
FROM best GROUP BY doc_id, item_id
"""

#: All pairs of a label, without the lattice.
NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, len(embedding) AS dims, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b USING (label, dims) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM reach r JOIN p ON r.v = p.u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM p GROUP BY u),
c AS (SELECT u AS vec_id, min(v) AS low FROM reach GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Every kept term of every pair of sources, without the sketch and without sparse sums.
DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
lv AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (gn.n + 2 * lv.v) AS p, 1 + 1000000000 * (k.c + 2) // (lv.n + 2 * lv.v) AS q
  FROM gn JOIN k ON gn.lang = k.lang JOIN lv ON gn.lang = lv.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM every UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: crc32 of the decimal id, a byte and then a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for x in range(8)]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""

#: Level by level over all nodes, then each document's way up.
MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(':' || lang, '-') AS g, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="low")} AS low
  FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM (SELECT *, {_CRC} AS crc FROM documents))),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, lvl, i, n, x) AS (SELECT g, 0, i, n, leaf FROM o UNION ALL SELECT g, any_value(lvl) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(x, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, i // 8),
s AS (SELECT g, x AS subroot, row_number() OVER (ORDER BY g) - 1 AS li, count(*) OVER () AS ln FROM t WHERE n = 1),
u(lvl, i, n, x) AS (SELECT 0, li, ln, subroot FROM s UNION ALL SELECT any_value(lvl) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(x, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 8),
h AS (SELECT g, max(lvl) AS h FROM t GROUP BY g),
tr AS (SELECT g, lvl, i // 8 AS run, list(x ORDER BY i) AS xs FROM t WHERE n > 1 GROUP BY ALL),
ur AS (SELECT lvl, i // 8 AS run, list(x ORDER BY i) AS xs FROM u WHERE n > 1 GROUP BY ALL),
w AS (
  SELECT o.g, o.i, tr.lvl AS lvl, xs, (o.i // CAST(pow(8, tr.lvl) AS BIGINT)) % 8 AS k FROM o JOIN tr ON tr.g = o.g AND tr.run = o.i // CAST(pow(8, tr.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT o.g, o.i, h.h + ur.lvl, xs, (s.li // CAST(pow(8, ur.lvl) AS BIGINT)) % 8 FROM o JOIN s USING (g) JOIN h USING (g) JOIN ur ON ur.run = s.li // CAST(pow(8, ur.lvl + 1) AS BIGINT)),
y AS (SELECT g, i, lvl, array_to_string(xs[1:k], '') AS a, array_to_string(xs[k + 2:], '') AS b FROM w),
proof AS (SELECT g, i, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof_sha256 FROM y GROUP BY g, i),
f(g, i, lvl, x) AS (SELECT g, i, 0, low FROM o UNION ALL SELECT f.g, f.i, f.lvl + 1, sha256(a || x || b) FROM f JOIN y ON y.g = f.g AND y.i = f.i AND y.lvl = f.lvl),
top AS (SELECT g, i, arg_max(x, lvl) AS folded_root FROM f GROUP BY g, i)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified, CASE WHEN o.g <> '-' THEN substr(o.g, 2) END AS lang, o.i AS position
FROM o JOIN s USING (g) LEFT JOIN proof USING (g, i) JOIN top USING (g, i), (SELECT x AS root FROM u WHERE n = 1)
"""


ORACLES: dict[str, str] = {"op2_license_scan": LICENSES, "op7_decontamination": LEAKS, "op11_lattice_near_duplicates": NEAR_VECTORS, "op12_source_divergence": DIVERGENCE, "op13_merkle_manifest": MANIFEST}
