"""Membership filter: rows of keys outside a known set leave before any shuffle.

A blocked Bloom filter made of plain columns. Every key of the set picks one 64-bit
word by its hash and sets ``PROBES`` bits in it; the words are built by one aggregate
(``bit_or``). A row passes if the word of its key holds all bits of its key. The probe
is a broadcast left semi join on the word, which Spark fuses with the scan and with
the partial aggregate above it, so a fact row of a key outside the set is neither
aggregated nor shuffled, however many such rows the key has. Keys of the set always
pass; about one other key in ``200`` passes as well, and the exact join later drops it.

The filter has at most ``MAX_WORDS`` rows (about 32 MB once broadcast). A set with more
than ``MAX_KEYS`` keys would wear it out, so there is no filter beyond that: the rows
are then aggregated unfiltered and the join after the aggregate drops the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from attrition.session import ensure_checkpoint_dir

PROBES = 4
KEY_BITS = 16
MAX_WORDS = 1 << 20
MAX_KEYS = MAX_WORDS * 64 // KEY_BITS


def words_for(n_keys: int) -> int:
    """Words for a set: a power of two with ``KEY_BITS`` bits or more for each key."""
    need = max(64, -(-n_keys * KEY_BITS // 64))
    return min(MAX_WORDS, 1 << (need - 1).bit_length())


@dataclass(frozen=True)
class Members:
    """The filter of one set of keys."""

    words: DataFrame  # word, bits
    n_words: int
    key_type: DataType

    def _word(self, key: Column) -> Column:
        return F.xxhash64(key.cast(self.key_type)).bitwiseAND(F.lit(self.n_words - 1))

    def _bits(self, key: Column) -> Column:
        """``PROBES`` bits, from another hash than the word's."""
        spread = F.xxhash64(key.cast(self.key_type), F.lit(1))
        places = (F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES))
        return reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in places))

    def flag(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """``rows`` with the boolean ``out``: whether the key may be in the set (the same
        answer for a key wherever it is asked)."""
        mine = F.col(f"`{key}`")
        held = self.words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        told = rows.join(F.broadcast(held), self._word(mine) == F.col("_word"), "left")
        has = F.coalesce(F.col("_bits").bitwiseAND(self._bits(mine)) == self._bits(mine), F.lit(False))
        return told.withColumn(out, has).drop("_word", "_bits")

    def keep(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be in the set; a null key is never in it."""
        mine = F.col(f"`{key}`")
        held = self.words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        match = (self._word(mine) == F.col("_word")) & (F.col("_bits").bitwiseAND(self._bits(mine)) == self._bits(mine))
        return rows.where(mine.isNotNull()).join(F.broadcast(held), match, "left_semi")


def members(keys: DataFrame, key: str, n_keys: int) -> Members | None:
    """The filter of the keys in column ``key`` (about ``n_keys``), written once to the
    shared checkpoint folder; None for a set that is too large for one."""
    if n_keys > MAX_KEYS:
        return None
    out = Members(words=keys, n_words=words_for(n_keys), key_type=keys.schema[key].dataType)
    mine = F.col(f"`{key}`")
    words = keys.where(mine.isNotNull()).groupBy(out._word(mine).alias("word")).agg(F.bit_or(out._bits(mine)).alias("bits"))
    ensure_checkpoint_dir(keys.sparkSession)
    return Members(words=words.checkpoint(eager=True), n_words=out.n_words, key_type=out.key_type)


def keep_members(filter_: Members | None, rows: DataFrame, key: str) -> DataFrame:
    return rows if filter_ is None else filter_.keep(rows, key)
