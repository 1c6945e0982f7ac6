"""The words of a vocabulary that are most like given words, exactly, whatever their lengths.

Words are alike by 2 * LCS / (sum of lengths).  The longest common subsequence can't hold more of a letter than either
word has, so twice the sum of the smaller letter counts, over the same lengths, bounds it from above.  The bounds of
all words of the vocabulary come from an inverted index of letter counts; subsequences are computed in falling order of
bounds, and the search ends when the next bound is below the k-th best found.

The vocabulary is dealt by a hash into shards of about SHARD_WORDS words; one at a time is broadcast and meets all asked
words in a pass over them, which carry what they have found so far, so a later shard is cut by it from the start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.scratch import discard, on, written

SHARD_WORDS, ASKED_WORDS = 1 << 16, 1 << 12
TOP = "array<struct<similarity:double,word:string>>"


def common(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a word (the bits at which it has each letter) and another."""
    full = (1 << size) - 1
    state = full
    for letter in other:
        hit = state & masks.get(letter, 0)
        state = (state + hit | state - hit) & full
    return size - state.bit_count()


class LetterIndex:
    """Postings of letters with their counts, over sorted words."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.size = np.fromiter(map(len, self.words), np.int64, len(words))
        posted: dict[str, tuple[list[int], list[int]]] = {}
        for at, word in enumerate(self.words):
            for letter, n in Counter(word).items():
                places, counts = posted.setdefault(letter, ([], []))
                places.append(at)
                counts.append(n)
        self.posted = {c: (np.array(p), np.array(n)) for c, (p, n) in posted.items()}

    def nearest(self, asked: str, k: int, found: list[tuple[float, str]]) -> list[tuple[float, str]]:
        """The k best of found (similarity, word) and this index's words, best first, ties in the words' order."""
        shared = np.zeros(len(self.words), np.int64)
        masks: dict[str, int] = {}
        for i, letter in enumerate(asked):
            masks[letter] = masks.get(letter, 0) | 1 << i
        for letter, mask in masks.items():
            if letter in self.posted:
                places, counts = self.posted[letter]
                shared[places] += np.minimum(counts, mask.bit_count())
        bound = 2.0 * shared / np.maximum(self.size + len(asked), 1)
        best = sorted((-s, w) for s, w in found)[:k]
        least = lambda: -best[-1][0] if len(best) == k else -1.0
        left = np.flatnonzero(bound >= least())
        take = 4 * k
        while len(left):
            order = np.argsort(-bound[left], kind="stable")
            for at in left[order[:take]]:
                if bound[at] < least():
                    return [(-s, w) for s, w in best]
                word = self.words[at]
                best = sorted([*best, (-2.0 * common(masks, len(asked), word) / (len(asked) + len(word)) if word else 0.0, word)])[:k]
            left, take = left[order[take:]], take * 4
            left = left[bound[left] >= least()]
        return [(-s, w) for s, w in best]


def nearest_words(asked: DataFrame, words: DataFrame, k: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(raw, top) of distinct asked words (raw): the k most similar words (token), each with its similarity, best
    first, ties by the word.  Fewer if there are fewer words; an empty vocabulary gives empty lists."""
    context = asked.sparkSession.sparkContext
    shards = max(1, -(-words.count() // shard_words))
    tasks = max(1, -(-asked.count() // ASKED_WORDS))
    out = asked.select("raw", F.expr(f"cast(array() as {TOP})").alias("top")).repartition(tasks, "raw")
    target = pa.schema([("raw", pa.string()), ("top", pa.list_(pa.struct([("similarity", pa.float64()), ("word", pa.string())])))])
    for shard in range(shards):
        mine = words.where(F.pmod(F.xxhash64("token"), F.lit(shards)) == shard).select("token").collect()  # about shard_words
        held = context.broadcast([r["token"] for r in mine])

        def meet(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = LetterIndex(held.value)
            for batch in batches:
                raws = batch.column(0).to_pylist()
                tops = [index.nearest(raw, k, [(t["similarity"], t["word"]) for t in top]) for raw, top in zip(raws, batch.column(1).to_pylist(), strict=True)]
                rows = [[{"similarity": s, "word": w} for s, w in top] for top in tops]
                yield pa.RecordBatch.from_arrays([pa.array(raws, target.field(0).type), pa.array(rows, target.field(1).type)], schema=target)

        old, out = out, written(out.mapInArrow(meet, f"raw string, top {TOP}"), "nearest")
        discard(old)
        held.unpersist()
    return on(out, out)
