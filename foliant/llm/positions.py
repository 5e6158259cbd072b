"""Word positions as rows, without Python: shared by the operators that hash windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, text_of

#: Rows up to which a table of hashes is broadcast (24 bytes each); a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def lower_words(text: Column) -> Column:
    """Lower-case words in order; a text of white space alone has none."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key and _words of each row; _key tells rows of one id but different texts apart."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), lower_words(text).alias("_words"))


def at_positions(frame: DataFrame, span: int) -> DataFrame:
    """A row for each position (_pos from 0) at which ``span`` words fit; texts with fewer words have no row."""
    last = F.size("_words") - span
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return frame.select("*", F.explode(places).alias("_pos"))


def word_hash(offsets: tuple[int, ...], seed: int = 0) -> Column:
    """Hash of the words at the given offsets from _pos."""
    return F.xxhash64(F.lit(seed), *[F.get(F.col("_words"), F.col("_pos") + o) for o in offsets])


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
