"""Spelling variants: words one edit apart, found by running Levenshtein automata through shards of a trie.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are made small.  A synthetic slip
is planted first: where SLIPS divides the crc32 h of `<doc_id>:<run>`, the run loses its code point h % length.  The
words that count have at least LEAST_LETTERS code points and LEAST_COUNT occurrences over all documents.

Occurrences are counted by one aggregation with partial sums.  The counted words are dealt by range into shards of
SHARD_WORDS words, each made into a compact trie in a task (byte edges, counts at the ends); at most
ROUND_SHARDS tries, about ROUND_SHARDS * 8 MB, reach the driver at a time and are broadcast.  Against each shard every
word's distance-one automaton is followed depth-first, for a batch of words at once: after a step with an edit nothing
but the rest of the word may follow, and such branches are run to their end before the plain path takes its next
letter.  An inserted or deleted letter counts at the end of a run of equal letters only, so that every neighbour is accepted
once.  Accepted neighbours are emitted as rows; one aggregation counts them and takes the best form.  Roots come from
doubling steps along the forms: a form has at least LEAST_RATIO times the count, so chains have no cycle and are
logarithmic in the largest count.

Defined cases: null and empty texts hold no runs; a null doc_id is written as nothing before the colon; rows with equal ids
count each; a run of one letter may become empty, a run as long as the text is followed whole; ties of forms go to
the smallest word in code-point order; other columns, whatever their names, are ignored; empty tables and tables without
such words give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import discard, on, written
from quarrystone.llm.ordered import in_blocks, running

RUN = "([A-Za-zÀ-ÿ]+)"
SLIPS = 199
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: Words of a trie, letters of a word that make it count as two, tries that are broadcast together, words that a task
#: follows together.
SHARD_WORDS, WORD_LETTERS, ROUND_SHARDS, BATCH_WORDS = 1 << 17, 32, 4, 1 << 13
_KINDS, _PARTS = (np.uint8, np.int32, np.int64, np.int64, np.int32), ("letters", "sizes", "counts", "edges", "word_at")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with_slip(run: Column, key: Column) -> Column:
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences, slips planted."""
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), _CAPITALS, _SMALL), F.lit(RUN), 1)).alias("run"))
    words = runs.where(F.char_length("run") >= letters).select(_with_slip(F.col("run"), F.col("id")).alias("word"))
    return words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


class Trie:
    """A trie of sorted distinct byte strings.  Nodes are numbered level by level; an edge is a number,
    parent * 256 + byte, and the edges are sorted, so an edge's place plus one is its child."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, counts: np.ndarray, edges: np.ndarray, word_at: np.ndarray):
        """The words' bytes, lengths and counts; the edges; the word that ends at each node, or -1."""
        self.flat, self.size, self.counts, self.edges, self.word_at = flat, size, counts, edges, word_at
        self.start = np.cumsum(size) - size
        self.first = np.searchsorted(edges, np.arange(len(word_at) + 1) * 256)

    @classmethod
    def built(cls, words: list[bytes], counts: list[int]) -> Trie:
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        node, ends = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # where each word's prefix and each word ends
        edges, total, depth, left = [np.zeros(0, np.int64)], 1, 0, np.arange(len(words))
        while True:
            done = size[left] == depth
            ends[left[done]] = node[left[done]]
            left = left[~done]
            if not len(left):
                break
            edge = node[left] * 256 + flat[start[left] + depth]
            new = np.concatenate(([True], edge[1:] != edge[:-1]))
            edges.append(edge[new])
            node[left] = total + np.cumsum(new) - 1
            total += len(edges[-1])
            depth += 1
        word_at = np.full(total, -1, np.int32)
        word_at[ends] = np.arange(len(words))
        return cls(flat, size, np.array(counts, np.int64), np.concatenate(edges), word_at)

    def packed(self) -> list[bytes]:
        return [x.astype(t).tobytes() for x, t in zip((self.flat, self.size, self.counts, self.edges, self.word_at), _KINDS, strict=True)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Trie:
        flat, size, counts, edges, word_at = (np.frombuffer(p, t) for p, t in zip(parts, _KINDS, strict=True))
        return cls(flat, size.astype(np.int64), counts, edges, word_at)

    def word(self, at: int) -> str:
        return self.flat[self.start[at] : self.start[at] + self.size[at]].tobytes().decode("latin-1")

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the nodes by these bytes, and a mask of the nodes that have one."""
        edge = node * 256 + byte
        at = np.searchsorted(self.edges, edge)
        found = at < len(self.edges)
        found[found] = self.edges[at[found]] == edge[found]
        return at + 1, found

    def neighbours(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places (in words, in the trie's words) of all pairs that are exactly one edit apart, each once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words) + b"\0\0", np.uint8).astype(np.int64)
        out_w, out_n = [], []

        def follow(w: np.ndarray, pos: np.ndarray, node: np.ndarray) -> None:
            """The edit is made: the rest of the word must follow."""
            while len(w):
                at_end = pos == size[w]
                hit = self.word_at[node[at_end]]
                out_w.append(w[at_end][hit >= 0])
                out_n.append(hit[hit >= 0])
                w, pos, node = w[~at_end], pos[~at_end], node[~at_end]
                child, found = self.step(node, flat[start[w] + pos])
                w, pos, node = w[found], pos[found] + 1, child[found]

        w, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        while len(w):
            inside = size[w] > depth
            next_byte = np.where(inside, flat[start[w] + depth], -1)
            n_children = self.first[node + 1] - self.first[node]
            each = np.repeat(np.arange(len(w)), n_children)
            edge = np.arange(len(each)) - np.repeat(np.cumsum(n_children) - n_children, n_children) + self.first[node][each]
            other = (self.edges[edge] & 255) != next_byte[each]
            each, child = each[other], edge[other] + 1
            follow(w[each], np.full(len(each), depth), child)  # inserted
            each, child = each[inside[each]], child[inside[each]]
            follow(w[each], np.full(len(each), depth + 1), child)  # replaced
            after = np.where(size[w] > depth + 1, flat[start[w] + depth + 1], -1)
            cut = inside & (after != next_byte)
            follow(w[cut], np.full(int(cut.sum()), depth + 1), node[cut])  # deleted
            w, node, next_byte = w[inside], node[inside], next_byte[inside]
            child, found = self.step(node, next_byte)
            w, node, depth = w[found], child[found], depth + 1
        empty = np.zeros(0, np.int64)
        return np.concatenate(out_w or [empty]), np.concatenate(out_n or [empty])


def _shards(words: DataFrame, shard_words: int) -> DataFrame:
    """(shard, a packed trie) of the words by range, as large whatever the number of partitions: a word counts as one,
    and once more for every WORD_LETTERS letters."""
    units = F.lit(0).cast("long").alias("all"), (1 + F.floor(F.char_length("word") / WORD_LETTERS)).alias("units")
    blocks = in_blocks(words.select("word", "n", *units), "word")
    dealt = running(blocks, "all", {"upto": ("sum", "units")}).select(F.floor((F.col("upto") - 1) / shard_words).alias("shard"), "word", "n")
    schema = pa.schema([("shard", pa.int64()), *((p, pa.binary()) for p in _PARTS)])

    def build(t: pa.Table) -> pa.Table:
        rows = sorted((w.encode("latin-1"), n) for w, n in zip(t["word"].to_pylist(), t["n"].to_pylist(), strict=True))
        parts = Trie.built([w for w, _ in rows], [n for _, n in rows]).packed()
        return pa.table([[t["shard"][0].as_py()], *([p] for p in parts)], schema=schema)

    out = written(dealt.groupBy("shard").applyInArrow(build, "shard long, " + ", ".join(f"{p} binary" for p in _PARTS)), "shards")
    discard(blocks)
    return out


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words (word, n: a written table) that are one edit apart."""
    context, n = words.sparkSession.sparkContext, words.count()
    shards = _shards(words, shard_words)
    names = sorted(r["shard"] for r in shards.select("shard").collect())  # one number for a trie
    schema = pa.schema({"word": pa.string(), "near": pa.string(), "near_n": pa.int64()})
    asked = words.select("word").repartition(max(1, -(-n // (2 * BATCH_WORDS))), "word")
    rounds = []
    for at in range(0, max(1, len(names)), round_shards):
        tries = context.broadcast([[bytes(r[p]) for p in _PARTS] for r in shards.where(F.col("shard").isin(names[at : at + round_shards])).collect()])

        def meet(batches: Iterator[pa.RecordBatch], tries=tries) -> Iterator[pa.RecordBatch]:
            against = [Trie.unpacked(p) for p in tries.value]
            mine: list[str] = []

            def found() -> Iterator[pa.RecordBatch]:
                as_bytes = [w.encode("latin-1") for w in mine]
                for trie in against:
                    a, b = trie.neighbours(as_bytes)
                    for cut in range(0, len(a), 1 << 16):
                        i, j = a[cut : cut + (1 << 16)].tolist(), b[cut : cut + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([mine[k] for k in i]), pa.array(map(trie.word, j.tolist())), pa.array(trie.counts[j])], schema=schema)
                mine.clear()

            for batch in batches:
                mine.extend(batch.column(0).to_pylist())
                if len(mine) >= BATCH_WORDS:
                    yield from found()
            if mine:
                yield from found()

        rounds.append(written(asked.mapInArrow(meet, "word string, near string, near_n long"), "near"))
        tries.unpersist()
    discard(shards)
    return on(reduce(DataFrame.unionByName, rounds), *rounds)


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last of the chain, by doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        old, at = at, written(at.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(old)
        if at.where("moved").isEmpty():
            return on(at.select("word", "root"), at)


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = written(word_counts(docs, key, text), "words")
    near = near_words(words, shard_words, round_shards)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    groups = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.m") >= LEAST_RATIO * F.col("n")
    judged = written(
        words.join(groups, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "judged"
    )
    discard(words, near)
    roots = _rooted(judged.where("form IS NOT NULL"))
    out = judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return on(out, judged, roots)
