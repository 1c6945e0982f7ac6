"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014), and
clusters that keep barred pairs apart."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.scratch import discard, on, written

#: So many edges, counted first, are settled by one task; more take rounds of joins.
SMALL_EDGES = 1 << 17
#: Edges of a component that one task settles in order, when it holds a barred pair.
MOST_EDGES = 1 << 16


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _settled(e: DataFrame) -> DataFrame:
    """(node, component) of at most SMALL_EDGES edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if kind:
            nodes = list(parent)
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, kind), "component": pa.array(map(root, nodes), kind)})

    kind = dict(e.dtypes)["u"]
    return e.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge.  Each round is written to the
    shared folder and the one before it removed; rounds grow with the logarithm of the longest path.  As soon as no
    more than small_edges are left, they are settled at once."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = _print(e)
    while True:
        if seen[0] <= small_edges:
            out = written(_settled(e), "components")
            discard(e)
            return out
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        old, e = e, written(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        discard(old)
        before, seen = seen, _print(e)
        if seen == before:
            leaves, roots = e.select(F.col("u").alias("node"), F.col("v").alias("component")), e.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return on(leaves.unionByName(roots.distinct()), e)


def clusters(nodes: DataFrame, edges: DataFrame, key: str = "record_key") -> DataFrame:
    """(key, cluster) of all nodes; a node without edges is its own cluster."""
    linked = components(edges, "left_key", "right_key")
    return nodes.select(key).distinct().join(linked.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def _relabelled(pairs: DataFrame, labels: DataFrame, *sides: str) -> DataFrame:
    """pairs with the nodes in these columns replaced by their labels (node, component), where they have one."""
    for side in sides:
        own = labels.select(F.col("node").alias(side), F.col("component").alias("_to"))
        pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return pairs


def _in_order(edges: DataFrame, bars: DataFrame) -> DataFrame:
    """(a, b): each node and the one that stands for its cluster, when the edges (component, a, b, no) of a component
    are taken one after the other by no and refused if they would bring a barred pair (component, a, b) together.
    One component is one group."""

    def solve(pdf):
        import pandas as pd

        parent: dict[str, str] = {}
        barred: dict[str, set] = {}  # by roots, of roots

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for r in pdf[pdf.no.isna()].itertuples():
            barred.setdefault(r.a, set()).add(r.b)
            barred.setdefault(r.b, set()).add(r.a)
        for r in pdf[pdf.no.notna()].sort_values("no").itertuples():
            a, b = root(r.a), root(r.b)
            if a != b and b not in barred.get(a, ()):
                if len(barred.get(a, ())) < len(barred.get(b, ())):
                    a, b = b, a
                parent[b] = a
                for other in barred.pop(b, ()):
                    barred[other].discard(b)
                    barred[other].add(a)
                    barred.setdefault(a, set()).add(other)
        return pd.DataFrame([(x, root(x)) for x in list(parent) if root(x) != x], columns=["a", "b"])

    rows = edges.select("component", "a", "b", F.col("no").cast("double")).unionByName(bars.select("component", "a", "b", F.lit(None).cast("double").alias("no")))
    return rows.groupBy("component").applyInPandas(solve, "a string, b string")


def _plain_prefixes(edges: DataFrame, bars: DataFrame, close: int) -> DataFrame:
    """(component, upto): for each component a number up to which its edges (component, a, b, no), taken together, bring
    no barred pair (component, a, b) together, and no more than close below the last such number; found by bisection
    for all components at once."""
    span = written(edges.groupBy("component").agg((F.min("no") - 1).alias("lo"), F.max("no").alias("hi")), "span")  # lo is plain, hi isn't
    while not span.where(F.col("hi") - F.col("lo") > close).isEmpty():
        mid = span.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
        upto = components(edges.join(mid, "component").where("no <= mid").select("a", "b"))
        met = _relabelled(bars, upto, "a", "b").where("a = b").select("component", F.lit(True).alias("met")).distinct()
        moved = mid.join(met, "component", "left").select("component", F.when(F.col("met"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("met"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        old, span = span, written(moved, "span")
        discard(old, upto)
    return on(span.select("component", F.col("lo").alias("upto")), span)


def constrained_clusters(nodes: DataFrame, edges: DataFrame, cannot: DataFrame, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters that keep cannot-link pairs (left_key, right_key) apart: edges join strongest first (score, then
    keys), and one that would bring such a pair together is refused.  Returns (record_key, cluster) and the edges
    with accepted.

    Components without a barred pair are plain.  Of the others, those of at most most_edges edges are settled in order,
    each in a group of its own.  A larger one is contracted: its strongest edges, as far as plain components bring no
    barred pair together, are all accepted; the next most_edges are settled in order; what is joined so far becomes one
    node.  Edges inside such a node are done, edges between nodes that hold a barred pair are refused, now or later
    alike, and of several between two nodes the first decides.  What is left falls into smaller components and goes the
    same way, so no group ever has more than most_edges edges, besides the bars between their nodes.  Clusters only grow,
    so an edge was accepted if its ends are in one cluster at last."""
    from quarrystone.operators.golden import numbered_rows

    left = edges.select(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b"), F.struct((-F.col("score")).alias("s"), "left_key", "right_key").alias("rank"))
    left = left.where("a <> b").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    left = written(left, "left")
    bars = cannot.select(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b")).where("a <> b").distinct()
    joins, held = [], [left]
    while True:
        of = components(left.select("a", "b"))
        at = of.withColumnRenamed("node", "a")
        met = _relabelled(bars.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), of, "x", "y").where("x = y")
        bars = written(met.select("a", "b", F.col("x").alias("component")), "bars")
        strict = bars.select("component").distinct()
        joins.append(of.join(strict, "component", "left_anti").select(F.col("node").alias("a"), F.col("component").alias("b")))
        # Numbers in the edges' order, dense in each component.
        numbered = numbered_rows(left.join(at, "a").join(strict, "component", "left_semi").select("component", "a", "b", "rank"), [F.asc("component"), F.asc("rank")])
        mine = written(numbered.select("component", "a", "b", "rank", F.col("_no").cast("long").alias("no")), "numbered")
        sizes = written(mine.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        few, many = (sizes.where(which).select("component") for which in (F.col("n") <= most_edges, F.col("n") > most_edges))
        joins.append(written(_in_order(mine.join(few, "component", "left_semi"), bars.join(few, "component", "left_semi")), "joined"))
        discard(numbered)
        held += [of, bars, mine, sizes, joins[-1]]
        if many.isEmpty():
            break
        mine, bars = mine.join(many, "component", "left_semi"), bars.join(many, "component", "left_semi")
        prefix = _plain_prefixes(mine.select("component", "a", "b", "no"), bars, most_edges)
        ranged = mine.join(prefix, "component")
        plain = components(ranged.where("no <= upto").select("a", "b"))
        rest = written(_relabelled(ranged.where("no > upto"), plain, "a", "b").where("a <> b"), "rest")
        bars = written(_relabelled(bars, plain, "a", "b"), "bars")
        batch = rest.where(F.col("no") <= F.col("upto") + most_edges)
        touched = batch.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        near = bars.join(touched.withColumnRenamed("node", "a"), "a", "left_semi").join(touched.withColumnRenamed("node", "b"), "b", "left_semi")
        settled = written(_in_order(batch, near), "joined")
        joins += [plain.select(F.col("node").alias("a"), F.col("component").alias("b")), settled]
        names = settled.select(F.col("a").alias("node"), F.col("b").alias("component"))
        rest2 = _relabelled(rest.where(F.col("no") > F.col("upto") + most_edges), names, "a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank").where("a <> b")
        bars2 = _relabelled(bars, names, "a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        held += [prefix, plain, rest, bars, settled]
        bars = written(bars2, "bars")
        left = written(rest2.join(bars, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("rank").alias("rank")), "left")
        held += [bars, left]
    every = reduce(DataFrame.unionByName, joins).withColumnsRenamed({"a": "left_key", "b": "right_key"})
    out = written(clusters(nodes, every), "clusters")
    discard(*held)
    end = lambda side: out.select(F.col("record_key").alias(side), F.col("cluster").alias(f"_{side}"))
    judged = edges.join(end("left_key"), "left_key").join(end("right_key"), "right_key").withColumn("accepted", F.col("_left_key") == F.col("_right_key"))
    return out, on(judged.select(*edges.columns, "accepted"), out)
