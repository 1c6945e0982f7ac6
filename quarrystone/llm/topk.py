"""Exact top-k by integer inner product, by aggregation of sorted lists without random access.

Candidates are cut into blocks of bounded size.  In a block each dimension is a list of postings sorted by value,
each with the candidate, its value and the squared length of its vector.  A query reads a list from the top where
its own value is positive, from the bottom where it is negative, a further stretch of every list each round.  A
round adds only its stretch to what is kept for each candidate and query: the score so far, and the squared lengths
of what is read of either vector.  From these come the bounds of a candidate's score:

* what is unread lies below the frontiers (query value times last value read);
* once a posting of the candidate was read, its length is known, so what is unread also lies within the length of
  the query's unread part times that of the candidate's (Cauchy and Schwarz).

The k-th best lower bound, of this block or of those before, is what an outsider must reach.  Candidates that reach
it for no query of the batch are given up and no longer added to.  When few are left, or the lists are read,
reading stops and the scores of those left are resolved.  Queries share their reads: a stretch is a matrix, and its
product with the query values adds it up for all queries of a batch at once.

Groups of candidates meet groups of queries, the stated query set, both of bounded size; each pair gives k rows a
query, and a second ranking joins them.  Ties go to the smaller id, so bounds only rule out what is strictly below.

Defined cases: null vectors and vectors with null or non-finite components take no part; missing trailing
components count as 0; rows with one id are one vector, the smallest of theirs component by component, and an id is
never its own candidate; fewer than k candidates give all; equal vectors are ranked by id; rows without id take no
part; other columns are ignored.  Scores are exact at any size of the components (beyond 2^26 by Python's integers);
one that a long can't hold counts as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.base import discard, on, written

SCALE = 256
#: Candidates and queries that meet in one task, and the sizes of the blocks they are taken in there.
GROUP_ROWS, GROUP_QUERIES = 8192, 4096
BLOCK_ROWS, BLOCK_QUERIES = 4096, 128
#: Shares of each list that have been read after each round.
ROUNDS = (0.25, 0.4, 0.6, 1.0)
_EXACT = 1 << 26  # products of two such numbers add up in a long
_LONGS = -(1 << 63), (1 << 63) - 1


def usable(key: str, vector: str) -> Column:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(key).isNotNull() & x.isNotNull() & ~bad


class Block:
    """A block of vectors (whole numbers as doubles) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        n, d = self.rows.shape
        order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, order, axis=0)
        self.place = np.empty((n, d), np.int32)  # of each entry in its list, from the bottom
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.squares = (self.rows**2).sum(axis=1)

    def near(self, q_ids: np.ndarray, w: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, query) positions that may be among the k best of the query (a column of w), or reach floor."""
        n, m = len(self.ids), w.shape[1]
        up, down = np.maximum(w, 0), np.minimum(w, 0)
        up1, down1 = (w > 0).astype(np.float64), (w < 0).astype(np.float64)
        length_q = (w**2).sum(axis=0)
        left, read = np.arange(n), 0  # candidates in play, entries read of each list
        rows, place = self.rows, self.place
        got, read_q, read_v = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
        for share in ROUNDS:
            to = min(n, int(np.ceil(n * share)))
            new_t, new_b = (place >= n - to) & (place < n - read), (place < to) & (place >= read)
            t, b = np.where(new_t, rows, 0.0), np.where(new_b, rows, 0.0)
            got += t @ up + b @ down
            read_q += new_t @ up**2 + new_b @ down**2
            read_v += (t**2) @ up1 + (b**2) @ down1
            read = to
            high, low = self.sorted[n - to][:, None] * up, self.sorted[to - 1][:, None] * down  # the frontiers
            below = (high + low).sum(axis=0) - (place >= n - to) @ high - (place < to) @ low
            seen = ((place >= n - to) | (place < to)).any(axis=1)[:, None]
            long = np.where(seen, self.squares[left][:, None], np.inf)
            with np.errstate(invalid="ignore"):
                reach = np.sqrt(np.nan_to_num(np.maximum(length_q - read_q, 0) * np.maximum(long - read_v, 0), nan=0.0, posinf=np.inf))
            error = 1e-6 + 1e-11 * np.sqrt(self.squares[left][:, None] * length_q)  # of the sums above
            lower, upper = got - reach - error, got + np.minimum(reach, below) + error
            own = self.ids[left][:, None] == q_ids[None, :]
            lower[own], upper[own] = -np.inf, -np.inf
            least = np.maximum(floor, np.partition(lower, len(left) - k, axis=0)[len(left) - k] if len(left) > k else -np.inf)
            least = np.where(least <= _LONGS[0], -np.inf, np.minimum(least, _LONGS[1]))  # beyond a long, scores tie
            mask = (upper >= least) & ~own
            if to == n or mask.sum() <= 8 * k * m:
                break
            play = mask.any(axis=1)
            if play.mean() < 0.8:
                left, rows, place, got, read_q, read_v = (x[play] for x in (left, rows, place, got, read_q, read_v))
        c, j = np.nonzero(mask)
        return left[c], j

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of candidates, the k best of each query among them."""
        c, j = self.near(q_ids, q.T, k, floor)
        if not len(c):
            return (np.zeros(0, np.int64),) * 3
        if max(np.abs(self.rows).max(initial=0), np.abs(q).max(initial=0)) < _EXACT:
            a, b = self.rows.astype(np.int64), q.astype(np.int64)
            score = np.concatenate([np.einsum("ij,ij->i", a[c[i : i + 65536]], b[j[i : i + 65536]]) for i in range(0, len(c), 65536)])
        else:
            whole = lambda v: [int(x) for x in v]
            exact = [sum(map(int.__mul__, whole(self.rows[x]), whole(q[y]))) for x, y in zip(c.tolist(), j.tolist(), strict=True)]
            score = np.array([min(max(s, _LONGS[0]), _LONGS[1]) for s in exact], np.int64)
        return j, self.ids[c], score


def best_of(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): the k best of each query among rows."""
    blocks = [Block(ids[i : i + BLOCK_ROWS], rows[i : i + BLOCK_ROWS]) for i in range(0, len(ids), BLOCK_ROWS)]
    out = []
    for a in range(0, len(q_ids), BLOCK_QUERIES):
        qi, qv = q_ids[a : a + BLOCK_QUERIES], q[a : a + BLOCK_QUERIES]
        floor, held = np.full(len(qi), -np.inf), (np.zeros(0, np.int64),) * 3
        for block in blocks:
            j, i, s = (np.concatenate(x) for x in zip(held, block.top(qi, qv, k, floor), strict=True))
            by = np.lexsort((i, ~s, j))  # ~s falls as s rises, without overflow
            j, i, s = j[by], i[by], s[by]
            rank = np.arange(len(j)) - np.searchsorted(j, j)
            floor[j[rank == k - 1]] = s[rank == k - 1]
            held = tuple(x[rank < k] for x in (j, i, s))
        out.append((qi[held[0].astype(np.int64)], held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, group_rows: int = GROUP_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each id in queries the k best other ids of vectors."""

    def whole(df: DataFrame) -> DataFrame:
        doubles = F.transform(vector, lambda v: v.cast("double"))
        return df.where(usable(key, vector)).select(F.col(key).cast("long").alias("id"), doubles.alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    rows, asked = written(whole(vectors), "vectors"), written(whole(queries), "queries")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_rows, n_asked = max(1, -(-shape["n"] // group_rows)), max(1, -(-asked.count() // group_queries))
    width = max(shape["d"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    to_each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select("id", "v", group(n_rows).alias("r"), to_each(n_asked).alias("q")).groupBy("r", "q")
    right = asked.select("id", "v", group(n_asked).alias("q"), to_each(n_rows).alias("r")).groupBy("r", "q")

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        m, v = np.zeros((t.num_rows, width)), t.column("v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        at = np.repeat(np.arange(t.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        m[at] = np.floor(scale * v.flatten().to_numpy())
        return t.column("id").to_numpy(), m

    def meet(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not candidates.num_rows or not questions.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        return pa.table(dict(zip(names, map(pa.array, best_of(*matrix(candidates), *matrix(questions), k)), strict=True)))

    near = written(left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long"), "near")
    discard(rows, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return on(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), near)
