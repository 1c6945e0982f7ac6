"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

A byte goes if a string of `LENGTH` bytes over it also starts earlier: in a document of smaller id, or earlier in
the same one.  Texts are their UTF-8 bytes and matches never cross documents.

1. Anchors.  Of each 100-byte string the smallest hash among its 32-byte strings is the anchor; equal strings have
   equal anchors.  Neighbouring strings with one anchor form a segment: one row for about 35 bytes.  Segments
   whose anchor is nowhere else are done.
2. Classes.  Segments with equal anchors and equal bytes are a class; all but its first are repeats throughout.
3. Suffix sort.  If an anchor has several classes, their first segments agree only in part.  What stands right of
   the anchor, and reversed what stands left of it, is sorted by a mergesort whose comparisons are logarithmic:
   prefix polynomial hashes tell in a few halvings how far two suffixes agree.  Two strings that begin l bytes
   before their anchors are equal if they agree l bytes to the left and 100 - l to the right, so runs of the two
   suffix arrays with long enough common prefixes give the groups of equal strings.  Members are compared with
   the first of their group byte by byte; they are repeats.
4. Blocks.  An anchor with more than `BLOCK_CLASSES` classes is dealt into blocks; what is left of them meets by two
   independent hashes of the 100 bytes, and all but the first of a group are repeats.

Each exchange is an aggregation that is combined before it is shuffled, or a join whose large keys Spark can
split; no group beyond a block's size is gathered in one task.

Defined cases: null text counts as empty; texts shorter than 100 bytes lose nothing; copies lose everything but
in the first; rows with the same id are one document read again, so neither removes from the other; null ids
count as one id before all others; very long texts are read whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, written
from quarrystone.llm.hashing import Powers, PrefixHash, mixed

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # 32-byte strings in a 100-byte string
#: String starts of a text that are looked at together; classes of an anchor, and suffixes, that are sorted together.
CHUNK = 1 << 20
BLOCK_CLASSES = 65_536  # of about 170 bytes
BATCH_SUFFIXES = 16_384
_PLACE = np.uint64((1 << 24) - 1)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)


def segments(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first start, number of starts) of a text's segments."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    parts = []
    for at, anchor, first, gram, h in _anchors(data, powers):
        n = np.diff(np.append(first, len(anchor)))
        shape = ((anchor[first] - first) * 128 + n).astype(np.uint64)
        parts.append((gram[anchor[first]], mixed(h.of(first, first + n + LENGTH - 1) ^ mixed(shape)), first + at, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, powers: Powers):
    """By chunks: where it begins, the anchor of each string start, the first starts of segments, gram hashes."""
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        h = PrefixHash(part, powers)
        grams = np.arange(len(part) - GRAM + 1)
        gram = mixed(h.of(grams, grams + GRAM))
        low = (gram & ~_PLACE) | grams.astype(np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(part) - LENGTH + 1], low[WINDOW - width : WINDOW - width + len(part) - LENGTH + 1])
        anchor = (low & _PLACE).astype(np.int64)
        yield at, anchor, np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), gram, h


def agreement(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes suffixes a and b have in common, up to most, by halving."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while len(i := np.flatnonzero(low < high)):
        mid = (low[i] + high[i] + 1) // 2
        same = h.of(a[i], a[i] + mid) == h.of(b[i], b[i] + mid)
        low[i], high[i] = np.where(same, mid, low[i]), np.where(same, high[i], mid - 1)
    return low


def suffix_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, h: PrefixHash) -> np.ndarray:
    """Positions of starts, ordered by group, then by the strings of their sizes (equal ones stay in order): a
    mergesort of doubling runs, all comparisons of a level at once."""
    out, n, run = np.argsort(groups, kind="stable"), len(starts), 1
    while run < n:
        at = np.arange(n)
        pair, right = at // (2 * run) * 2 * run, (at // run) % 2 == 1
        low = np.where(right, pair, np.minimum(pair + run, n))
        begin, high = low.copy(), np.where(right, pair + run, np.minimum(pair + 2 * run, n))
        while len(i := np.flatnonzero(low < high)):
            mid = (low[i] + high[i]) // 2
            x, y = out[i], out[mid]
            order = np.sign(groups[y] - groups[x])
            near = np.flatnonzero(order == 0)
            p, q = x[near], y[near]
            most = np.minimum(sizes[p], sizes[q])
            same = agreement(h, starts[p], starts[q], most)
            last = len(data) - 1
            bytes_ = data[np.minimum(starts[q] + same, last)].astype(np.int64) - data[np.minimum(starts[p] + same, last)]
            order[near] = np.where(same < most, np.sign(bytes_), np.sign(sizes[q] - sizes[p]))
            before = (order < 0) | ((order == 0) & right[i])  # the other run's element comes first
            low[i], high[i] = np.where(before, mid + 1, low[i]), np.where(before, high[i], mid)
        new = np.empty_like(out)
        new[pair + (at - np.where(right, pair + run, pair)) + (low - begin)] = out
        out, run = new, 2 * run
    return out


def neighbours(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, h: PrefixHash) -> np.ndarray:
    """Of each sorted suffix, the bytes in common with the one before; -1 for the first of a group."""
    a, b = order[:-1], order[1:]
    same = agreement(h, starts[a], starts[b], np.minimum(sizes[a], sizes[b]))
    return np.concatenate(([-1], np.where(groups[a] == groups[b], same, -1))).astype(np.int64)


def equal_strings(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, n: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, distance, first): strings of elements, beginning `distance` bytes before their anchors, that equal
    one of element `first` of the same group, the earliest.  Elements come earliest first.  contexts[i] holds n[i]
    strings, the anchor stands left[i] bytes from its begin."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    long = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(long) - long
    anchor = begin + left
    back = data[::-1]
    sides = []
    for text, at, size in ((data, anchor, long - left), (back, len(data) - anchor, left)):
        h = PrefixHash(text, powers)
        order = suffix_sort(text, at, size, groups, h)
        sides.append((order, neighbours(order, at, size, groups, h)))
    found, few = [], left - n + 1
    for distance in range(WINDOW):
        held = np.flatnonzero((few <= distance) & (distance <= left))
        if len(held) < 2:
            continue
        ids = []
        for (order, common), least in zip(sides, (LENGTH - distance, distance), strict=True):
            run = np.empty(len(groups), np.int64)
            run[order] = np.cumsum(common < least)
            ids.append(run[held])
        by = np.lexsort((held, *ids))
        new = np.concatenate(([True], (ids[0][by][1:] != ids[0][by][:-1]) | (ids[1][by][1:] != ids[1][by][:-1])))
        first = held[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.flatnonzero(~new)
        found.append((held[by][later], np.full(len(later), distance), first[later]))
    e, d, f = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    ok, span = np.ones(len(e), bool), np.arange(LENGTH)
    for i in range(0, len(e), 1 << 16):
        j = slice(i, i + (1 << 16))
        ok[j] = (data[(anchor[e[j]] - d[j])[:, None] + span] == data[(anchor[f[j]] - d[j])[:, None] + span]).all(axis=1)
    return e[ok], d[ok], f[ok]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, n): string starts whose 100 bytes start earlier too; doc is the id (null: -2^63)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text).alias("text"))

    def cut():
        powers = Powers()

        def work(cols):
            out = [[], [], [], []]
            for k, t in zip(*cols, strict=True):
                a, s, first, n = segments(np.frombuffer((t or "").encode(), np.uint8), powers)
                for column, v in zip(out, (a.view(np.int64), s.view(np.int64), np.full(len(a), k), first * 128 + n), strict=True):
                    column.append(v)
            return [np.concatenate(c) if c else [] for c in out]

        return work

    rows = arrow_map(docs, cut, ["doc", "text"], "anchor long, hash long, doc long, at long")
    # Written, so that both sides of the join are plain exchanges, whose large keys Spark can split.
    common = written(rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "common")
    _release(spark)
    found = written(rows.join(common, "anchor"), "segments")
    classes = written(found.groupBy("anchor", "hash").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("c")), "classes")
    copies = found.join(classes.where("c > 1").select("anchor", "hash", "first"), ["anchor", "hash"]).where("doc <> first.doc or at <> first.at")
    whole = copies.select("doc", F.shiftright("at", 7).alias("start"), F.col("at").bitwiseAND(127).alias("n"))
    several = written(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "several")
    blocks = F.ceil(F.col("classes") / BLOCK_CLASSES).cast("int")
    firsts = classes.join(several, "anchor").select("anchor", "first.doc", "first.at", blocks.alias("blocks"))
    asked = written(firsts.groupBy("doc").agg(F.collect_list(F.struct("at", "anchor", "blocks")).alias("asked")), "asked")
    _release(spark)

    def contexts():
        powers = Powers()

        def work(cols):
            out = [[], [], [], [], [], [], []]
            for d, t, want in zip(*cols, strict=True):
                data = np.frombuffer(b := (t or "").encode(), np.uint8)
                left = dict(zip(*segment_anchors(data, powers), strict=True))
                for x in want:
                    p, n = x["at"] >> 7, x["at"] & 127
                    if p in left:  # not another row's with the same id
                        for column, v in zip(out, (x["anchor"], x["blocks"], d, p, n, left[p], b[p : p + n + LENGTH - 1]), strict=True):
                            column.append(v)
            return out

        return work

    texts = docs.join(asked, "doc").select("doc", "text", "asked")
    rows = arrow_map(texts, contexts, ["doc", "text", "asked"], "anchor long, blocks int, doc long, start long, n long, left long, context binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc", "start"), F.col("blocks")).cast("int"))
    rows = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "doc", "start")
    strings = written(rows.mapInArrow(_sorted_blocks, "doc long, start long, n long, h1 long, h2 long"), "strings")
    _release(spark)
    apart = strings.where("h1 IS NOT NULL")
    earliest = apart.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = apart.join(earliest, ["h1", "h2"]).where("doc <> first.doc or start <> first.start").select("doc", "start", "n")
    return whole.unionByName(strings.where("h1 IS NULL").select("doc", "start", "n")).unionByName(later)


def segment_anchors(data: np.ndarray, powers: Powers) -> tuple[list[int], list[int]]:
    """First starts of the segments, and how far behind each its anchor stands."""
    starts, lefts = [], []
    for at, anchor, first, _, _ in _anchors(data, powers):
        starts += (first + at).tolist()
        lefts += (anchor[first] - first).tolist()
    return starts, lefts


def _sorted_blocks(batches):
    """Rows come by anchor and block.  Gives ranges of repeats (h1 null), and of anchors with several blocks also the
    strings that are the first of their block, with hashes."""
    import pyarrow as pa

    powers, held, size = Powers(), [], 0
    names = ("anchor", "block", "blocks", "doc", "start", "n", "left", "context")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor, block, blocks, doc, start, n, left = (np.array([r[i] for r in rows], np.int64) for i in range(7))
        by = np.lexsort((start, doc))
        group = np.unique(np.stack([anchor, block]), axis=1, return_inverse=True)[1].ravel()[by]
        anchor, block, blocks, doc, start, n, left = (x[by] for x in (anchor, block, blocks, doc, start, n, left))
        texts = [rows[i][7] for i in by]
        e, d, f = equal_strings(group, texts, left, n, powers)
        own = (doc[e] != doc[f]) | (start[e] != start[f])
        e, d = e[own], d[own]
        begin = start[e] + left[e] - d
        by = np.lexsort((begin, e))
        e2, begin2 = e[by], begin[by]
        new = np.concatenate(([True], (e2[1:] != e2[:-1]) | (begin2[1:] != begin2[:-1] + 1))) if len(e2) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        out = [(doc[e2[at]], begin2[at], np.diff(np.append(at, len(e2))))]
        h1s, h2s = [np.zeros(len(at), np.int64)], [np.zeros(len(at), np.int64)]
        gone = set(zip(e.tolist(), d.tolist(), strict=True))
        for i in np.flatnonzero(blocks > 1):
            data = np.frombuffer(texts[i], np.uint8)
            open_ = np.array([k for k in range(n[i]) if (i, left[i] - k) not in gone], np.int64)
            one, two = PrefixHash(data, powers).of(open_, open_ + LENGTH), PrefixHash(data, powers, _SECOND).of(open_, open_ + LENGTH)
            out.append((np.full(len(open_), doc[i]), start[i] + open_, np.ones(len(open_), np.int64)))
            h1s.append(mixed(one).view(np.int64))
            h2s.append(mixed(two).view(np.int64))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] + [np.concatenate(h1s), np.concatenate(h2s)]
        hidden = np.arange(len(columns[0])) < len(at)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.int64(), mask=hidden) for c in columns[3:])], ["doc", "start", "n", "h1", "h2"])

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if size >= BATCH_SUFFIXES and row[:2] != held[-1][:2]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += 1
    if held:
        yield solve(held)


def _release(spark) -> None:
    """Let go of the shuffle files of stages that are written: the driver drops them with its references."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_bytes(data: bytes, starts: list[int], ns: list[int]) -> tuple[bytes, int, int]:
    """(remaining bytes, number of removed ones, number of removed runs)."""
    if not starts:
        return data, 0, 0
    step = np.zeros(len(data) + 1, np.int32)
    s = np.array(starts)
    np.add.at(step, s, 1)
    np.add.at(step, s + np.array(ns) + LENGTH - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spots = written(repeats(docs, key, text).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spots")), "spots")
    _release(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text).alias("text")).join(spots, "doc", "left")

    def make():
        def work(cols):
            out = [[], [], [], [], [], []]
            for k, t, found in zip(*cols, strict=True):
                data = (t or "").encode()
                kept, n, runs = kept_bytes(data, [x["start"] for x in found or ()], [x["n"] for x in found or ()])
                for column, v in zip(out, (k, len(data), n, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(v)
            return out

        return work

    return arrow_map(rows, make, ["id", "text", "spots"], f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
