"""Packing of tokenised documents into sequences by best fit and a swap-based local search.

Pieces are dealt by a hash of their identity into blocks of a bounded size.  A block is packed best-fit
decreasing; then the search takes its emptiest bin and, while that raises the sum of squared fills, moves a
document out of it, exchanges one of its documents for a shorter one elsewhere, or two for one, until the bin is
empty and goes.  Bins that stay open are packed once more, together with those of other blocks.

Defined cases: null or empty text is a document of one token (the end id); only documents longer than the
capacity are cut; equal documents are packed each; the result is the same for any order of the rows; an empty
table gives an empty result; rows with null or equal ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, keep_store, written
from quarrystone.llm.token_counts import SHARED_CLASSES

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together; a task holds no more.
BLOCK_PIECES = 8192
#: A bin with more free tokens than this share of the capacity is packed again at the second level.
OPEN_SHARE = 0.01
#: Words and runs of words without blanks kept with their ids in a worker, about 130 MB.
WORDS_KEPT = 800_000
#: Characters that str.split takes for blanks and the vocabulary's splitter doesn't, or the other way round.
ODD_BLANKS = re.compile("[\x1c-\x1f\x85]")


class WordIds:
    """Token ids of whole texts, word by word: this vocabulary's merges never cross the words of its splitter."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        keep_store(__name__, self.known.clear)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text:  # perhaps a special string, which is one id
            return self.whole(text)
        if not text.isascii():
            if SHARED_CLASSES.search(text):
                return self.whole(text)
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        # No word crosses a blank, so what stands between blanks is looked up as one.
        keys, known = self.find(text) if ODD_BLANKS.search(text) else text.split(), self.known
        try:
            return b"".join([known[k] for k in keys])
        except KeyError:
            long = self.learn(keys)
        out = b"".join([known[k] for k in keys])
        for k in long:
            known.pop(k, None)
        return out

    def learn(self, keys: list[str]) -> list[str]:
        """Ids of new words and of runs of words, the words all in one call; gives those too long to keep."""
        known = self.known
        new = {k for k in keys if k not in known}
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = set(keys)
        runs = [(k, self.find(k)) for k in new if not k.isalpha()]
        words = {k for k in new if k.isalpha()}
        words.update(w for _, ws in runs for w in ws if w not in known)
        words = list(words)
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        # One call for all words; each ends with the only one of its tokens that ends a word.
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        data = ids.tobytes()
        known.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        for k, ws in runs:
            known[k] = b"".join([known[w] for w in ws])
        return [k for k in (*words, *new) if len(k) > 64]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each document's pieces."""

    def make():
        w, end = word_ids(path), np.array([end_id], "<u4").tobytes()

        def work(cols):
            out = [[], [], [], [], []]
            for k, t in zip(*cols, strict=True):
                data = w.ids(t or "") + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, v in zip(out, (k, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            return out

        return work

    return arrow_map(docs, make, [key, text], f"{key} {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions.  Longest first, each into the fullest bin that has room; a bit mask of the free sizes
    finds that bin at once."""
    bins, by_room, mask = [], [[] for _ in range(capacity + 1)], 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        mask |= 1 << (room - n)
    return bins


def search(bins: list[list[int]], lengths: list[int], capacity: int, steps: int = 20_000) -> list[list[int]]:
    """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills.  steps bounds the
    exchanges; each strictly raises the sum, so the search ends in any case."""
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    held = [sorted((lengths[i], i) for i in b) for b in bins]
    live = {b for b in range(len(bins)) if fill[b] < capacity}
    gone = stuck = 0

    def shift(a: int, b: int, out: list, back: list) -> None:
        """Documents out go from bin a to b, documents back from b to a."""
        for x in out:
            held[a].remove(x)
            insort(held[b], x)
        for y in back:
            held[b].remove(y)
            insort(held[a], y)
        d = sum(x[0] for x in out) - sum(y[0] for y in back)
        fill[a] -= d
        fill[b] += d

    def better(a: int, others: list[int]) -> bool:
        for x in reversed(held[a]):
            if b := next((b for b in others if capacity - fill[b] >= x[0]), None):
                shift(a, b, [x], [])
                return True
        best = (0, None)
        for b in others:
            room = capacity - fill[b]
            if room <= best[0]:
                break  # others come with the most room first
            for x in held[a]:
                # the shortest y that x can take the place of: x - y <= room, x > y
                at = bisect_left(held[b], (x[0] - room, -1))
                if at < len(held[b]) and 0 < (d := x[0] - held[b][at][0]) <= room and d > best[0]:
                    best = (d, (b, [x], [held[b][at]]))
        if not best[1] and len(held[a]) <= 64:
            for b in others[:64]:
                room = capacity - fill[b]
                for k, x in enumerate(held[a]):
                    for z in held[a][k + 1 :]:
                        both = x[0] + z[0]
                        at = bisect_left(held[b], (both - room, -1))
                        if at < len(held[b]) and 0 < (d := both - held[b][at][0]) <= room and d > best[0]:
                            best = (d, (b, [x, z], [held[b][at]]))
        if best[1]:
            shift(a, *best[1])
        return bool(best[1])

    while len(bins) - gone > least and len(live) > 1 and steps > 0:
        order = sorted(live, key=lambda b: (fill[b], b))
        if stuck >= min(8, len(order) - 1):
            break
        a = order[stuck]
        # Only exchanges into bins at least as full raise the sum of squares.
        while held[a] and steps > 0:
            steps -= 1
            others = sorted((b for b in live if b != a and fill[b] >= fill[a]), key=lambda b: (fill[b], b))
            if not better(a, others):
                break
        live -= {b for b in live if fill[b] == capacity}
        if held[a]:
            stuck += 1
        else:
            live.discard(a)
            gone, stuck = gone + 1, 0
    return [[i for _, i in h] for h in held if h]


def pack_block(rows: pd.DataFrame, capacity: int, level: int, key: str) -> pd.DataFrame:
    rows = rows.sort_values([key, "piece"], kind="stable", na_position="first").reset_index(drop=True)
    lengths = rows["length"].tolist()
    base = (level << 60) + (int(rows["block"].iloc[0]) << 24)
    seq, at, free = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for b, held in enumerate(search(best_fit(lengths, capacity), lengths, capacity)):
        used = 0
        for i in held:
            seq[i], at[i] = base + b, used
            used += lengths[i]
        free[held] = capacity - used
    return rows.drop(columns="block").assign(sequence_id=seq, offset=at, free=free)


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """parts (key, piece, length, more) with sequence_id and offset."""
    parts = written(parts, "pieces")

    def level(df: DataFrame, no: int) -> DataFrame:
        blocks = max(1, -(-df.count() // block_pieces))
        kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return (
            df.withColumn("block", F.pmod(F.xxhash64(F.lit(no), F.col(key), F.col("piece")), F.lit(blocks)))
            .groupBy("block")
            .applyInPandas(lambda rows: pack_block(rows, capacity, no, key), f"{kinds}, sequence_id long, offset long, free long")
        )

    first = written(level(parts, 0), "packed")
    shut = F.col("free") <= int(capacity * OPEN_SHARE)
    again = level(first.where(~shut).drop("sequence_id", "offset", "free"), 1)
    return first.where(shut).unionByName(again).drop("free")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, key, text), capacity, key)
