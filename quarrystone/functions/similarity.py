"""Token-sort similarity: 2 LCS / (length a + length b) on names with sorted words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that one long holds, a bit each, with room for one carry.
WORD_BITS = 61


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " +"), lambda w: w != "")), " ")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: what a lambda reads is computed again for each element otherwise."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def lcs_short(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a of at most WORD_BITS characters.  One bit for each
    character of a; each character of b clears a bit for every column where the length grows."""
    places = F.transform(F.split(a, ""), lambda ch, i: F.struct(ch.alias("ch"), _bit(i).alias("bit")))

    def count(known: Column) -> Column:
        def step(state: Column, ch: Column) -> Column:
            mask = F.aggregate(F.filter(known["places"], lambda p: p["ch"] == ch), F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(p["bit"]))
            hit = state.bitwiseAND(mask)
            return (state + hit).bitwiseOR(state - hit).bitwiseAND(known["full"])

        return F.length(a) - F.bit_count(F.aggregate(F.split(b, ""), known["full"], step))

    return _let(F.struct(places.alias("places"), (_bit(F.length(a)) - 1).alias("full")), count)


def lcs_long(a: Column, b: Column) -> Column:
    """The same for a of any length: its bits are in several longs, and the sum's carry goes from one to the next."""
    places = F.transform(F.split(a, ""), lambda ch, i: F.struct(ch.alias("ch"), F.floor(i / WORD_BITS).cast("int").alias("word"), _bit(i % WORD_BITS).alias("bit")))
    words = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / WORD_BITS).cast("int"))
    full = F.transform(words, lambda w: _bit(F.least(F.lit(WORD_BITS), F.length(a) - w * WORD_BITS)) - 1)
    none = F.expr("named_struct('carry', 0L, 'state', cast(array() as array<bigint>))")

    def count(known: Column) -> Column:
        def step(state: Column, ch: Column) -> Column:
            def next_state(here: Column) -> Column:
                def word(done: Column, w: Column) -> Column:
                    mask = F.aggregate(here, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.when(p["word"] == w, p["bit"]).otherwise(0)))

                    def added(v: Column) -> Column:
                        total = v["old"] + v["hit"] + done["carry"]
                        new = total.bitwiseOR(v["old"] - v["hit"]).bitwiseAND(F.get(known["full"], w))
                        return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.concat(done["state"], F.array(new)).alias("state"))

                    return _let(F.struct(F.get(state, w).alias("old"), F.get(state, w).bitwiseAND(mask).alias("hit")), added)

                return F.aggregate(known["words"], none, word, lambda done: done["state"])

            return _let(F.filter(known["places"], lambda p: p["ch"] == ch), next_state)

        left = F.aggregate(F.aggregate(F.split(b, ""), known["full"], step), F.lit(0), lambda n, v: n + F.bit_count(v))
        return F.length(a) - left

    return _let(F.struct(places.alias("places"), words.alias("words"), full.alias("full")), count)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 1; 0 if either is null or empty.  Names of any length; the shorter one's characters are the bits."""

    def ratio(v: Column) -> Column:
        common = F.when(F.length(v["a"]) <= WORD_BITS, lcs_short(v["a"], v["b"])).otherwise(lcs_long(v["a"], v["b"]))
        some = (F.length(v["a"]) > 0) & (F.length(v["b"]) > 0)
        return F.when(some, F.when(v["a"] == v["b"], 1.0).otherwise(2.0 * common / (F.length(v["a"]) + F.length(v["b"])))).otherwise(0.0)

    def ordered(v: Column) -> Column:
        turned = F.length(v["b"]) < F.length(v["a"])
        return _let(F.struct(F.when(turned, v["b"]).otherwise(v["a"]).alias("a"), F.when(turned, v["a"]).otherwise(v["b"]).alias("b")), ratio)

    return _let(F.struct(sorted_words(a).alias("a"), sorted_words(b).alias("b")), ordered)
