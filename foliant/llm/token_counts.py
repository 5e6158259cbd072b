"""Exact token counts by dynamic programming over prefixes.

A merge vocabulary has one encoding for each byte string, and every prefix of that encoding is the
encoding of its own text.  So one token ends at each prefix, and it is the only vocabulary entry that
ends there and stands next to the token before it without merging across the border.  Filling that
table from left to right gives the count at every prefix in one pass; no prefix is encoded anew.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keeps, map_arrow
from .pretokens import Splitter

_BLANK = regex.compile(r"\s+")
#: Words whose counts a worker keeps; beyond that it starts afresh, so memory stays bounded.
KEPT_WORDS = 800_000
#: Words of the texts that are counted together.
GROUP_WORDS = 2_000_000
#: Adjacent tokens whose verdict a worker keeps.
KEPT_PAIRS = 600_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes under one byte-level vocabulary file (tokenizers .json)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        raw = lambda name: bytes(letters[c] for c in name)
        self.special = [t["content"] for t in model["added_tokens"] if t.get("special")]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {t for t in model["model"]["vocab"] if t not in self.special}
        self.ids = {raw(t): model["model"]["vocab"][t] for t in names}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.halves = {made: pair for pair, (_, made) in self.merges.items()}
        self.born = {made: rank for rank, made in self.merges.values()}
        #: Every ending of a vocabulary entry: its id, or -1 where the ending is none itself.
        self.ends = {b[i:]: -1 for b in self.ids for i in range(len(b))} | self.ids
        self.words, self.find = regex.compile(pattern), Splitter(pattern)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.totals = _Totals(self)
        self.totals.update(dict.fromkeys(self.special, 1))

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token."""
        if (known := self.alone.get(token)) is None:
            known = token not in self.halves or (
                all(map(self.stands_alone, self.halves[token])) and self._apart(*self.halves[token], self.born[token])
            )
            self.alone[token] = known
        return known

    def border_holds(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay apart."""
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.stands_alone(right) and self._apart(left, right, len(self.merges))
        return known

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether nothing merges across the border before merge ``until``.

        Takes the merges next to the border back, the latest first: at each moment the two tokens
        there must not have a merge that comes before the one just taken back.
        """
        while True:
            if (met := self.merges.get((left, right))) is not None and met[0] < until:
                return False
            if self.born.get(left, -1) > self.born.get(right, -1):
                until = self.born[left]
                left = self.halves[left][1]
            elif right in self.halves:
                until = self.born[right] + 1  # of equal merges the left one, across the border, comes first
                right = self.halves[right][0]
            else:
                return True

    def table(self, word: bytes, last: list[int] | None = None, count: list[int] | None = None, known: int = 0) -> list[int]:
        """Counts at byte prefixes 0..len(word) of one pre-token.

        ``last`` and ``count`` may hold the rows of another word that begins with the same ``known`` bytes.
        """
        n = len(word)
        last, count = last or [-1] * (n + 1), count or [0] * (n + 1)
        ends, pairs = self.ends, self.pairs
        for end in range(known + 1, n + 1):
            fits = []
            for start in range(end - 1, -1, -1):
                token = ends.get(word[start:end])
                if token is None:
                    break
                if token >= 0:
                    fits.append((start, token))
            while True:  # exactly one entry passes, most often the longest
                start, token = fits.pop()
                if start:
                    holds = pairs.get(last[start] << 20 | token)
                    if holds is None:
                        holds = self.border_holds(last[start], token)
                else:
                    holds = self.stands_alone(token)
                if holds:
                    last[end], count[end] = token, count[start] + 1
                    break
        return count

    def learn(self, words: set[str]) -> None:
        """Totals of new pre-tokens in one sorted pass: a word goes on in the table of the one before it where they part."""
        totals = self.totals
        if len(totals) + len(words) > KEPT_WORDS:
            totals.clear()
            totals.update(dict.fromkeys(self.special, 1))
        before, size = b"", 256
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for word in sorted(words):
            data = word.encode()
            if len(data) > size:
                totals[word] = self.table(data)[-1]
                continue
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            self.table(data, last, count, shared)
            totals[word] = count[len(data)]
            before = data

    def count_all(self, texts: list[str]) -> list[int]:
        """Counts of whole texts; the texts are taken in groups so that the words held at once stay bounded."""
        out: list[int] = []
        group: list[list[str]] = []
        held = 0
        for at, text in enumerate(texts):
            group.append(found := self.split(text))
            held += len(found)
            if held > GROUP_WORDS or at + 1 == len(texts):
                if new := set().union(*group).difference(self.totals):
                    self.learn(new)  # may drop older words; these are found one by one again
                out += [sum(map(self.totals.__getitem__, words)) for words in group]
                group, held = [], 0
        return out

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and these strings themselves (marked true)."""
        if not self.split_special:
            return [(text, False)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings come as themselves."""
        if self.split_special and self.split_special.search(text):
            return [w for part, special in self.pieces(text) for w in ((part,) if special else self.find(part))]
        return self.find(text)

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.split(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Exact counts of text[:i] for i in 0..len(text), each as if that prefix were encoded by itself."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base = at = 0
        for part, special in self.pieces(text):
            if special:
                # an unfinished special string is ordinary text that continues the part before it
                for cut in range(1, len(part)):
                    out[at + cut] = self._open(text, at, part[:cut], out)
                at += len(part)
                base += 1
                out[at] = base
                continue
            self._fill(part, at, base, out)
            at += len(part)
            base = int(out[at])
        return out

    def _open(self, text: str, at: int, begun: str, out: np.ndarray) -> int:
        start = max((text.rfind(s, 0, at) + len(s) for s in self.special if text.rfind(s, 0, at) >= 0), default=0)
        return int(out[start]) + sum(map(self.totals.__getitem__, self.words.findall(text[start:at] + begun)))

    def _fill(self, part: str, at: int, base: int, out: np.ndarray) -> None:
        before, blank_from, blank_base, blanks = base, None, base, []
        for m in self.words.finditer(part):
            word = m[0]
            if word[0].isspace() and blank_from is None:
                blank_from, blank_base = m.start(), before
                blanks = self._within(_BLANK.match(part, blank_from)[0])
            counts = self._within(word)
            for cut in range(1, len(word) + 1):
                stop = m.start() + cut
                if blank_from is not None and word[cut - 1].isspace():
                    # white space at the end of a text is one pre-token from where the run began
                    out[at + stop] = blank_base + blanks[stop - blank_from]
                else:
                    out[at + stop] = before + counts[cut]
            before += counts[-1]
            if not word.isspace():
                blank_from = None

    def _within(self, word: str) -> list[int]:
        """Counts at character prefixes of one pre-token."""
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():  # 're, 've and 'll begin as a quote and a letter
            return [0, *(sum(map(self.totals.__getitem__, self.words.findall(word[:k]))) for k in range(1, len(word) + 1))]
        data = word.encode()
        counts = self.table(data)
        if len(data) == len(word):
            return counts
        ends = np.cumsum([0, *(len(c.encode()) for c in word)])
        return [counts[e] for e in ends]

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens (0 if even one token is too many).

        The words' totals say in which word the budget ends; the prefix tables of it and its neighbours give the
        place.  A prefix that ends in a later word has all tokens of the words before it, so none of those fits.
        """
        if self.split_special and self.split_special.search(text):
            return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])
        words = self.find(text)
        counts = np.cumsum([0, *map(self.totals.__getitem__, words)])
        if counts[-1] <= budget:
            return len(text)
        last = first = int(np.searchsorted(counts, budget, side="right")) - 1  # the first word that ends beyond the budget
        while first and words[first - 1].isspace():
            first -= 1
        first = max(0, first - 1)
        while first and words[first - 1].isspace():
            first -= 1
        while last + 1 < len(words) and (words[last].isspace() or counts[last] <= budget):
            last += 1
        part = "".join(words[first : last + 1])
        found = np.zeros(len(part) + 1, np.int64)
        found[0] = counts[first]
        self._fill(part, 0, int(counts[first]), found)
        return sum(map(len, words[:first])) + int(np.flatnonzero(found <= budget)[-1])


class _Totals(dict):
    """Counts of whole pre-tokens, filled by the prefix table when first seen."""

    def __init__(self, owner: PrefixCounter):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
            self.update(dict.fromkeys(self.owner.special, 1))
        found = self.owner.table(word.encode())[-1]
        if len(word) <= 64:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


keeps(__name__, counter.cache_clear)


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return (name if "/" in name else public_tokenizers.path(name)), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_chars for each row.

    ``limit_chars`` is the length of the longest prefix of at most ``limit`` tokens, read off the prefix tables.  Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids come back as they came;
    an empty table gives an empty result; other columns are not read, so their names can't clash.
    Texts are counted whole whatever their length.
    """

    def make():
        model = counter(*_vocabulary(vocabulary))

        def step(batch: pa.RecordBatch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = model.count_all(texts)
            fits = [len(t) if c <= limit else model.fitting(t, limit) for t, c in zip(texts, counts)]
            yield {id_col: batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts], "limit_chars": fits}

        return step

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint")


def prefix_token_counts(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", budget: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens array<int> (the exact count of each character prefix, from the empty one on) and budget_chars.

    ``budget_chars`` is the longest prefix that fits ``budget`` tokens, the whole text without a budget.
    Null texts give [0] and 0.  ``element_at(prefix_tokens, n + 1)`` answers any later truncation at n characters.
    """

    def make():
        model = counter(*_vocabulary(vocabulary))

        def step(batch: pa.RecordBatch):
            for at in range(batch.num_rows):  # one text at a time: the array is longer than the text
                text = batch.column(1)[at].as_py() or ""
                counts = model.prefixes(text)
                fits = len(text) if budget is None else int(np.flatnonzero(counts <= budget)[-1])
                yield {id_col: batch.column(0).slice(at, 1), "prefix_tokens": [counts.tolist()], "budget_chars": [fits]}

        return step

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, prefix_tokens array<int>, budget_chars bigint")
