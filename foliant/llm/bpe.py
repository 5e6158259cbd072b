"""Byte-level BPE encoding and decoding with DuckDB's recursive queries, one database in each task.

The distinct pre-tokens of a batch become token-position rows that begin as single bytes.  Each round
of the recursive query joins neighbours with the merge table and contracts the leftmost pair of least
rank in every word; a word without such a pair leaves, so the recursion ends at the fixpoint.  Decoding
joins token positions with the vocabulary and aggregates the bytes in the order of the positions.

Pre-tokens of more than LONG_WORD bytes take a keyed recursion, which holds one row a position instead of
every round's, and contracts all places of a word's least pair in one round: a run of one letter ends
after a few rounds.  That is the same result as one place at a time unless the merged token is part of an entry
of lower rank (``alone``), and such pairs are contracted one by one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keeps, map_arrow
from .pretokens import Splitter

#: Words whose ids a worker keeps; beyond that it starts afresh.
KEPT_WORDS = 300_000
#: Bytes of distinct words in one recursive query, which bounds its rows.
QUERY_BYTES = 500_000
#: Tokens decoded by one query.
QUERY_TOKENS = 500_000
#: Bytes of a pre-token from which on its recursion is keyed.
LONG_WORD = 200

#: Positions count through all words with a gap after each, so one number finds a neighbour.  ``place`` is the least rank and
#: then the leftmost position; ``span`` has the two positions that end the pair.
_ENCODE = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, pos + 1 AS nxt, 0 AS round FROM start_rows
    UNION ALL
    (WITH best AS (
        SELECT a.word AS word,
               min(m.merged::BIGINT << 32 | a.pos) AS place,
               arg_min(a.nxt::BIGINT << 32 | b.nxt, m.merged::BIGINT << 32 | a.pos) AS span
        FROM state a JOIN state b ON a.nxt = b.pos
        JOIN merges m ON a.tok::BIGINT << 32 | b.tok = m.pair
        GROUP BY a.word)
     SELECT s.word, s.pos,
            CASE WHEN s.pos = place & 4294967295 THEN (place >> 32)::INT ELSE s.tok END,
            CASE WHEN s.pos = place & 4294967295 THEN (span & 4294967295)::INT ELSE s.nxt END,
            s.round + 1
     FROM state s JOIN best ON s.word = best.word WHERE s.pos <> span >> 32)
), ended AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, tok FROM state JOIN ended USING (word, round) ORDER BY word, pos
"""

#: The same with one row for each position: contracted ones have token -1.  Of places that overlap (a run) every other one is taken.
_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok, nxt) USING KEY (word, pos) AS (
    SELECT word, pos, tok, pos + 1 FROM start_rows
    UNION
    (WITH live AS (SELECT word, pos, tok, nxt FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state)),
     pairs AS (
        SELECT a.word, a.pos, a.nxt AS mid, b.nxt AS stop, m.merged, m.alone
        FROM live a JOIN live b ON a.nxt = b.pos
        JOIN merges m ON a.tok::BIGINT << 32 | b.tok = m.pair),
     least AS (SELECT word, min(merged::BIGINT << 32 | pos) AS place FROM pairs GROUP BY word),
     met AS (
        SELECT p.word, p.pos, p.mid, p.stop, p.merged FROM pairs p JOIN least l ON p.word = l.word
        WHERE p.merged = place >> 32 AND (NOT alone OR p.pos = place & 4294967295)),
     begun AS (SELECT *, CASE WHEN lag(mid) OVER (PARTITION BY word ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM met),
     runs AS (SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS run FROM begun),
     chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1)
     SELECT word, pos, merged, stop FROM chosen UNION ALL SELECT word, mid, -1, -1 FROM chosen)
)
SELECT word, tok FROM state WHERE tok >= 0 ORDER BY word, pos
"""

#: Bytes travel as the characters of the same numbers, since a token may end inside a character.
_DECODE = """
SELECT text, string_agg(letters, '' ORDER BY pos) AS letters
FROM token_rows JOIN vocabulary USING (tok) GROUP BY text
"""


class Coder:
    """Encoder and decoder for one file of ranks (tiktoken format)."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        rank = {base64.b64decode(token): int(n) for token, n in pairs}
        self.split, self.size = Splitter(pattern), len(rank)
        self.single = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        halves = [(rank[t[:k]], rank[t[k:]], n) for t, n in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        ahead = {part for left, right, n in halves for part in (left, right) if part > n}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "160MB"})
        self._table("merges", {"pair": [left << 32 | right for left, right, _ in halves], "merged": pa.array([n for _, _, n in halves], pa.int32()), "alone": [n in ahead for _, _, n in halves]})
        self._table("vocabulary", {"tok": pa.array([*rank.values()], pa.int32()), "letters": [t.decode("latin-1") for t in rank]})
        self.kept: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def learn(self, words: list[str]) -> None:
        """Ids of new pre-tokens, kept as little-endian 32-bit bytes."""
        if len(self.kept) + len(words) > KEPT_WORDS:
            self.kept.clear()
        coded = [(word, word.encode()) for word in words]
        long = [x for x in coded if len(x[1]) > LONG_WORD]
        for sql, mine in ((_ENCODE, [x for x in coded if len(x[1]) <= LONG_WORD] if long else coded), (_ENCODE_LONG, long)):
            group, held = [], 0
            for x in mine:
                group.append(x)
                held += len(x[1])
                if held > QUERY_BYTES:
                    self._recurse(sql, group)
                    group, held = [], 0
            if group:
                self._recurse(sql, group)

    def _recurse(self, sql: str, group: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(d) for _, d in group])
        owner = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        found = self._query(
            sql,
            "start_rows",
            {"word": owner, "pos": np.arange(len(owner), dtype=np.int32) + owner, "tok": self.single[np.frombuffer(b"".join(d for _, d in group), np.uint8)]},
        )
        ends = np.cumsum(np.bincount(found["word"].to_numpy(), minlength=len(group))) * 4
        flat = found["tok"].to_numpy().astype("<u4").tobytes()
        start = 0
        for (word, _), end in zip(group, ends.tolist()):
            self.kept[word] = flat[start:end]
            start = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for at, text in enumerate(texts):
            group.append(found := self.split(text))
            held += len(found)
            if held > 500_000 or at + 1 == len(texts):
                words = set().union(*group)
                if new := words.difference(self.kept):
                    self.learn(sorted(new))
                    if missing := words.difference(self.kept):  # these made room
                        self.learn(sorted(missing))
                out += [b"".join(map(self.kept.__getitem__, words)) for words in group]
                group, held = [], 0
        return out

    def decode_all(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for; ids outside the vocabulary raise KeyError."""
        out = [b""] * len(encoded)
        group: list[int] = []
        held = 0
        for at, ids in enumerate(encoded):
            group.append(at)
            held += len(ids) // 4
            if held > QUERY_TOKENS or at + 1 == len(encoded):
                sizes = np.array([len(encoded[n]) // 4 for n in group])
                starts = np.cumsum(sizes) - sizes
                tokens = np.frombuffer(b"".join(encoded[n] for n in group), dtype="<u4")
                if len(tokens) and tokens.max() >= self.size:
                    raise KeyError(f"id {tokens.max()} is not in the vocabulary")
                found = self._query(_DECODE, "token_rows", {"text": np.repeat(np.array(group, dtype=np.int32), sizes), "pos": (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32), "tok": tokens.astype(np.int32)})
                for n, letters in zip(found["text"].to_pylist(), found["letters"].to_pylist()):
                    out[n] = letters.encode("latin-1")
                group, held = [], 0
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


keeps(__name__, coder.cache_clear)


def _coder(vocabulary: str) -> Coder:
    import public_tokenizers

    return coder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def _with_kind(frame: DataFrame, name: str) -> str:
    return f"`{name}` {frame.schema[name].dataType.simpleString()}"


def encode(docs: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row; null and empty texts give an empty array.

    Repeated rows and null ids come back as they came, an empty table gives an empty result, and other
    columns are not read.  Texts are encoded whole; a pre-token of any length is one unit.
    """

    def make():
        model = _coder(vocabulary)

        def step(batch: pa.RecordBatch):
            encoded = model.encode_all([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
            flat = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
            yield {id_col: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

        return step

    return map_arrow(docs.select(id_col, text_col), make, f"{_with_kind(docs, id_col)}, ids array<int>")


def decode(tokens: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text (bytes that aren't UTF-8 become the replacement character); null ids give an empty text."""

    def make():
        model = _coder(vocabulary)

        def step(batch: pa.RecordBatch):
            encoded = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield {id_col: batch.column(0), "text": [b.decode("utf-8", "replace") for b in model.decode_all(encoded)]}

        return step

    return map_arrow(tokens.select(id_col, ids_col), make, f"{_with_kind(tokens, id_col)}, text string")


def round_trip(docs: DataFrame, *, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoding and then decoding in one pass.

    Nulls count as empty texts (0 tokens and the digests of no bytes).
    """

    def make():
        model = _coder(vocabulary)

        def step(batch: pa.RecordBatch):
            encoded = model.encode_all([t or "" for t in batch.column(1).to_pylist()])
            yield {
                id_col: batch.column(0),
                "n_tokens": [len(e) // 4 for e in encoded],
                "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in model.decode_all(encoded)],
            }

        return step

    return map_arrow(docs.select(id_col, text_col), make, f"{_with_kind(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
