"""Lexicons of any size tested inside the row: a fixed-size bit mask of word hashes before tokens are exploded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MASK_BITS = 1 << 19      # 64 KB, whatever the size of the lexicon


def word_mask(lexicon: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that every word of ``lexicon`` passes, and few others.

    One bit for each hash value, as a Bloom filter with one hash: with 7,500 words one other token in 70 passes, with 50,000
    one in eleven; a join with the lexicon decides. Only the mask, at most ``MASK_BITS`` bits, reaches the driver, and it
    enters the plan as one constant.
    """
    place = F.pmod(F.xxhash64(column), F.lit(MASK_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    slots = lexicon.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("slot")).agg(F.bit_or(bit).alias("bits"))
    words = [0] * (MASK_BITS // 64)
    for row in slots.collect():
        words[row.slot] = row.bits
    mask = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def passes(word: Column) -> Column:
        h = F.pmod(F.xxhash64(word), F.lit(MASK_BITS))
        return F.getbit(F.get(mask, F.shiftright(h, 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1

    return passes
