"""Benchmark decontamination by a prefix-filtered set join, distributed on both sides.

An item's windows are runs of `window` words (all its words, if it has fewer).  A window is the set of its shingles
of `SHINGLE` words (fewer in a shorter window) with their places.  A document that contains a window has all its
shingles, so in an order by rarity - the number of documents a shingle is in, counted over the whole corpus - the
necessary prefix of a window is its rarest shingle.  Documents post that shingle wherever they have it, with the
words around.  Postings and windows meet in a join on the shingle; its place in the window gives the one place
where the window can begin (positional bound), which must lie inside the document with all its words (length
bound); the words there are compared with the window's.

Two passes read the documents: one counts the benchmark's shingles, one posts the prefix shingles.  A bitmap tells
most other shingles away before they leave a task.  It is all that is broadcast, at most 32 MB whatever the size of
the benchmark, and lets more through if it is too small for it.  Verdicts are per distinct text, so copies meet
before they are joined.

Defined cases: null or wordless texts have no words and are never hit; items without words have no window;
several items may share a window and all count; an item id that occurs twice counts once in the list, its texts
are taken together; items with a null id can't be listed and are left out; an empty benchmark hits nothing, an
empty table gives an empty result; null and repeated document ids are judged by row; very long texts are read
whole; other columns, whatever their names, are ignored by `contamination` and kept by `clean`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, discard, fresh, on, written
from quarrystone.llm.hashing import Bitmap, Powers, PrefixHash

WINDOW = 13
SHINGLE = 4
#: Bytes that separate words: ASCII without digits and letters.  Capitals become small letters.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


class Shingles:
    """Hashes of all word shingles of a text."""

    def __init__(self, ws: list[bytes], powers: Powers):
        self.data = b" ".join(ws)
        b = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(b == 32)
        self.starts, self.ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
        self.hash = PrefixHash(b, powers)

    def of(self, size: int) -> np.ndarray:
        return self.hash.of(self.starts[: len(self.starts) - size + 1], self.ends[size - 1 :]).view(np.int64)

    def words(self, begin: int, end: int) -> str:
        return self.data[self.starts[begin] : self.ends[end - 1]].decode()


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, window, words, size, shingles): a row for each window of each item; size is that of its shingles."""

    def make():
        powers = Powers()

        def work(cols):
            out = [[], [], [], [], []]
            for item, text in zip(*cols, strict=True):
                if ws := words(text):
                    n, s = min(window, len(ws)), Shingles(ws, powers)
                    size = min(SHINGLE, n)
                    h = s.of(size)
                    for i in range(len(ws) - n + 1):
                        for column, v in zip(out, (item, s.words(i, i + n), n, size, h[i : i + n - size + 1]), strict=True):
                            column.append(v)
            return out

        return work

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text")).where("item IS NOT NULL")
    return arrow_map(items, make, ["item", "item_text"], "item string, window string, words int, size int, shingles array<long>")


def text_hash(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _document_frequency(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, n): in how many documents each of shingles is."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap(shingles, "shingle"))

    def make():
        powers, wanted = Powers(), shared.value

        def work(cols):
            out = []
            for t in cols[0]:
                if ws := words(t):
                    s = Shingles(ws, powers)
                    for size in sizes:
                        if size <= len(ws):
                            h = s.of(size)
                            out.append(np.unique(h[wanted.may_hold(h)]))
            return [np.concatenate(out) if out else []]

        return work

    found = arrow_map(docs, make, ["text"], "shingle long")
    return found.groupBy("shingle").agg(F.count("*").alias("n")).join(shingles, "shingle", "left_semi")


def _posted(docs: DataFrame, prefix: DataFrame, sizes: list[int], window: int, kind: str) -> DataFrame:
    """A row (id, text hash, n_words) for each document, and one (text hash, n_words, shingle, at, lead, around) for
    each prefix shingle: it is word `at` of the text and word `lead` of the words around."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap(prefix, "shingle"))

    def make():
        powers, wanted = Powers(), shared.value

        def work(cols):
            out = [[], [], [], [], [], [], []]

            def add(*row):
                for column, v in zip(out, row, strict=True):
                    column.append(v)

            for k, t, digest in zip(*cols, strict=True):
                n = len(ws := words(t))
                add(k, digest, n, None, None, None, None)
                s = Shingles(ws, powers) if n else None
                for size in sizes:
                    if size <= n:
                        h = s.of(size)
                        for at in np.flatnonzero(wanted.may_hold(h)).tolist():
                            begin = max(0, at - window + 1)
                            add(None, digest, n, int(h[at]), at, at - begin, s.words(begin, min(n, at + window)))
            return out

        return work

    return arrow_map(docs, make, ["id", "text", "hash"], f"id {kind}, hash binary, n_words long, shingle long, at int, lead int, around string")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (id, text, hash): written tables with (id, hash, n_words) and more for each row, and (hash, n_hit,
    items, contaminated) for each text that is hit."""
    every = written(windows(benchmark, window), "windows")
    distinct = written(every.groupBy("window", "words", "size").agg(F.first("shingles").alias("shingles")), "distinct")
    sizes = [r["size"] for r in distinct.select("size").distinct().collect()]  # of 1 to SHINGLE
    shingles = written(distinct.select(F.explode("shingles").alias("shingle")).distinct(), "shingles")
    frequency = _document_frequency(docs, shingles, sizes)
    placed = distinct.select("window", "words", F.posexplode("shingles").alias("place", "shingle")).join(frequency, "shingle", "left")
    # A window with a shingle that no document has occurs nowhere.
    rarest = placed.groupBy("window", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("r")).where("r.n > 0")
    prefix = written(rarest.select("window", "words", "r.shingle", "r.place"), "prefix")
    kept = written(prefix.select("shingle").distinct(), "kept")
    rows = written(_posted(docs, kept, sizes, window, dict(docs.dtypes)["id"]), "rows")
    posted = rows.where("shingle IS NOT NULL").select("hash", "n_words", "shingle", "at", "lead", "around").distinct()
    begin = F.col("at") - F.col("place")
    inside = (begin >= 0) & (begin + F.col("words") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(F.lit(1), F.col("lead") - F.col("place") + 1), F.col("words")), " ") == F.col("window")
    hits = written(posted.join(prefix, "shingle").where(inside).where(same).select("hash", "n_words", begin.alias("begin"), "words", "window").distinct(), "hits")

    def cover(a: Column, x: Column) -> Column:
        end = x["begin"] + x["words"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["begin"]))).alias("n"))

    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    marks = hits.groupBy("hash", "n_words").agg(F.aggregate(F.array_sort(F.collect_set(F.struct("begin", "words"))), none, cover, lambda a: a["n"]).cast("long").alias("n_hit"))
    of = every.select("item", "window").distinct()
    items = hits.select("hash", "window").distinct().join(of, "window").select("hash", "item").distinct()
    items = items.groupBy("hash").agg(F.array_sort(F.collect_list("item")).alias("items"))
    verdicts = marks.join(items, "hash").select("hash", "n_hit", "items", (20 * F.col("n_hit") >= F.col("n_words")).alias("contaminated"))
    verdicts = written(verdicts, "verdicts")
    discard(every, distinct, shingles, prefix, kept, hits)
    return rows, verdicts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids)."""
    rows, verdicts = _judged(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_hash(text).alias("hash")), benchmark, window)
    found = rows.where("shingle IS NULL").select("id", "hash", "n_words").join(verdicts, "hash", "left")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return on(
        found.select(
            F.col("id").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
            items.alias("items"),
        ),
        rows,
        verdicts,
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns.  Texts are judged, so ids may be null,
    repeated or missing, and the size of the benchmark doesn't matter."""
    rows, verdicts = _judged(docs.select(F.lit(None).cast("int").alias("id"), F.col(text).alias("text"), text_hash(text).alias("hash")), benchmark, window)
    discard(rows)
    name = fresh(docs, "hash")
    bad = verdicts.where("contaminated").select(F.col("hash").alias(name))
    return on(docs.withColumn(name, text_hash(text)).join(bad, name, "left_anti").select(docs.columns), verdicts)
