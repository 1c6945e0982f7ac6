"""Near-duplicate documents by a signature-coordinate inverted join.

Each distinct shingle set has a MinHash signature of `COORDINATES` values and is posted under every
coordinate-value pair.  Two sets count as candidates if they collide on at least `LEAST_MATCHES` coordinates; at a
similarity of 0.75 a pair misses that with a probability of about 3e-6.

Skip merging: lists of one member can't collide and are left out; a set with fewer than LEAST_MATCHES lists left
has no partner.  Prefix: of its k lists a set keeps the k - LEAST_MATCHES + 1 shortest (in one order for all);
two sets with enough collisions share one of them, so the longest lists - common passages - are never walked.

Only components are asked for, so lists aren't expanded into pairs.  Each list's members are held against one
hub, the set whose lists are the longest: the middle of a group of near copies.  Sets about as similar to a hub
as `NEAR` form a pool.  Inside a pool that isn't linked throughout, the sets outside its largest linked part are
compared with all others, in blocks of bounded size, by counting shared shingles in an inverted index; only the
links that join something leave the task.

A list with sets of several pools holds what is mostly unlike, perhaps very many documents with one passage.  Its
sets are posted once more, under the rarest of their shingles: of the u shingles that others have too, a set with
n shingles needs ceil(0.75 n) in common with a partner, so the u - ceil(0.75 n) + 1 rarest are enough, and none if
u is less.  Bounds by size and by position in that order come before signatures, and links are confirmed on the
full sets.  Nothing is lost by this second prefix, and a passage that is less than 3/4 of its texts costs nothing.

Shingles are 64-bit xxh3 hashes of the words' bytes, sets are told apart by 128 bits.

Defined cases: exact copies are one set and meet by its hash, however many; null, empty and blank texts have no
shingles (n_shingles 0), are linked with nothing and are their own component; fewer words than a shingle make one
shingle; rows with one id are one document, so all their sets are linked; rows with null ids have the
component of their set and aren't kept, and a set that only they have has a null one and links nothing; very long texts are read whole; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.base import arrow_map, discard, on, written
from quarrystone.operators.components import components

WORDS = 5
SIMILARITY = 75  # per cent
COORDINATES = 48
LEAST_MATCHES = 22
NEAR = 40  # per cent
#: Sets and shingles in a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19
#: Odd multipliers and offsets of the coordinates' hash functions, from a fixed seed.
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    data = b" ".join((text or "").encode().lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    k = min(size, len(starts))
    spans = map(slice, starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, map(data.__getitem__, spans)), np.uint64))


def signature(h: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[None, at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return (low >> np.uint64(33)).astype(np.int32)


def set_hash(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Per row of docs (id, text): id, n_shingles, set hash (h1, h2), sig."""

    def make():
        def work(cols):
            out = [[], [], [], [], []]
            for k, t in zip(*cols, strict=True):
                h = shingles(t, size)
                row = (k, len(h), *set_hash(h), signature(h).tolist() if len(h) else [])
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return out

        return work

    return arrow_map(docs, make, ["id", "text"], f"id {dict(docs.dtypes)['id']}, n_shingles long, h1 long, h2 long, sig array<int>")


def set_hashes(docs: DataFrame, size: int) -> DataFrame:
    def make():
        def work(cols):
            sets = [shingles(t, size) for t in cols[1]]
            names = [set_hash(h) for h in sets]
            return [cols[0], [a for a, _ in names], [b for _, b in names], [h.view(np.int64) for h in sets]]

        return work

    return arrow_map(docs, make, ["id", "text"], f"id {dict(docs.dtypes)['id']}, h1 long, h2 long, shingles array<long>")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id, kept."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sig = written(signatures(docs, size), "signatures")
    some = sig.where("n_shingles > 0")
    # A distinct set is a node, named by a number that is written with it.
    sets = some.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")).where("id IS NOT NULL")
    sets = written(sets.withColumn("doc", F.monotonically_increasing_id()), "sets")
    posted = sets.select("doc", F.posexplode("sig").alias("c", "v")).select("doc", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    own = Window.partitionBy("doc")
    ranked = posted.join(shared, "list").withColumn("k", F.count("*").over(own)).where(F.col("k") >= LEAST_MATCHES)
    ranked = ranked.withColumn("at", F.row_number().over(own.orderBy("size", "list")))
    ranked = ranked.withColumn("fame", F.sum(F.ln("size")).over(own))
    prefix = written(ranked.where(F.col("at") <= F.col("k") - LEAST_MATCHES + 1).select("list", "doc", "fame"), "prefix")
    held = written(prefix.select("doc").distinct().join(sets, "doc"), "held")
    texts = set_hashes(docs.join(held.select("id").distinct(), "id", "left_semi"), size)
    full = written(held.join(texts, ["id", "h1", "h2"]).select("doc", "n", "sig", "shingles").dropDuplicates(["doc"]), "full")
    found = _links(prefix, full)
    links = written(found.unionByName(_same_id(some, sets)), "links")
    discard(prefix, held, full, found)
    of = components(links, "doc", "other")
    first = of.join(sets.select(F.col("doc").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("first"))
    first = of.join(first, "component").select(F.col("node").alias("doc"), "first")
    groups = written(sets.join(first, "doc", "left").select("h1", "h2", F.coalesce("first", "id").alias("first")), "groups")
    discard(sets, links, of)
    out = sig.join(groups, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("id"))
    return on(out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")), sig, groups)


def _same_id(some: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (doc, other) of the sets of one id."""
    several = some.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("id IS NOT NULL AND lo <> hi").select("id")
    held = some.join(several, "id").select("id", "h1", "h2").join(sets.select("h1", "h2", "doc"), ["h1", "h2"])
    return held.join(held.groupBy("id").agg(F.min("doc").alias("other")), "id").where("doc <> other").select("doc", "other").distinct()


def _links(prefix: DataFrame, full: DataFrame) -> DataFrame:
    """(doc, other): links whose components are those of all links."""
    hubs = prefix.groupBy("list").agg(F.max(F.struct("fame", "doc"))["doc"].alias("hub"))
    stars = prefix.join(hubs, "list").where("doc <> hub").select("doc", F.col("hub").alias("other")).distinct()
    near = written(_compared(stars, full, NEAR), "near")
    near_to = components(near, "doc", "other")
    pools = near_to.withColumnRenamed("component", "pool")
    linked = near.where(_similar(F.col("common"), F.col("na"), F.col("nb"))).select("doc", "other")
    inside = _inside_pools(pools, linked, full)
    of = prefix.join(pools.withColumnRenamed("node", "doc"), "doc", "left").select("list", "doc", F.coalesce("pool", "doc").alias("pool"))
    several = of.groupBy("list").agg(F.min("pool").alias("lo"), F.max("pool").alias("hi")).where("lo <> hi").select("list")
    apart = written(of.join(several, "list", "left_semi").select("doc", "pool").distinct().join(full, "doc"), "apart")
    likely = _across(apart)
    across = _compared(likely, apart, SIMILARITY).select("doc", "other")
    return on(linked.unionByName(inside).unionByName(across), near, near_to, inside, apart, likely)


def _across(apart: DataFrame) -> DataFrame:
    """(doc, other): sets of different pools that may be linked, by the rarest shingles of each."""
    need = F.expr(f"({SIMILARITY} * n + 99) div 100")
    posted = apart.select("doc", "pool", "n", need.alias("need"), F.explode("shingles").alias("s"))
    common = posted.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("doc")
    ranked = posted.join(common, "s").withColumn("u", F.count("*").over(own)).where("u >= need")
    ranked = ranked.withColumn("at", F.row_number().over(own.orderBy("f", "s"))).where("at <= u - need + 1")
    # Sets within 3/4 of each other's size are in the same or neighbouring classes.
    ranked = written(ranked.select("doc", "pool", "n", "need", "s", (F.col("u") - F.col("at") + 1).alias("rest"), F.floor(F.ln("n") / F.ln(F.lit(1.34))).alias("class")), "rare")
    one = ranked.select("s", "class", *(F.col(c).alias(f"{c}_a") for c in ("doc", "pool", "n", "need", "rest")))
    two = ranked.select("s", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), *(F.col(c).alias(f"{c}_b") for c in ("doc", "pool", "n", "need", "rest")))
    fits = F.least("rest_a", "rest_b") >= F.greatest("need_a", "need_b")
    likely = (F.col("doc_a") < F.col("doc_b")) & (F.col("pool_a") != F.col("pool_b")) & _similar(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")) & fits
    found = one.join(two, (one["s"] == two["s"]) & (one["class"] == two["class"]) & likely).select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other")).distinct()
    return on(found, ranked)


def _similar(common: Column, na: Column, nb: Column, percent: int = SIMILARITY) -> Column:
    return 100 * common >= percent * (na + nb - common)


def _matches(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _compared(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(doc, other, na, nb, common) of the pairs whose sets are at least so similar: by size and signature first."""
    a = full.select("doc", F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = full.select(F.col("doc").alias("other"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(a, "doc").join(b, "other").where(_similar(F.least("na", "nb"), F.col("na"), F.col("nb"), percent))
    likely = sized.where(_matches("sa", "sb") >= LEAST_MATCHES * percent // SIMILARITY).select("doc", "other", "na", "nb")
    x = full.select("doc", F.col("shingles").alias("x"))
    y = full.select(F.col("doc").alias("other"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    out = likely.join(x, "doc").join(y, "other").select("doc", "other", "na", "nb", common.alias("common"))
    return out.where(_similar(F.col("common"), F.col("na"), F.col("nb"), percent))


def forest(ids: list, sets: list[np.ndarray], side: list[bool], parts: list, across: bool) -> list[tuple[int, int]]:
    """Links (positions) that join sets of different parts (labels of what is linked already), from comparing
    each set with all before it by counting shared shingles; if across, only with the other side's.
    No more links than sets."""
    sides = np.array(side, bool)
    if len(sets) < 2 or across and (sides.all() or not sides.any()):
        return []
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.cumsum([0, *map(len, sets)])
    # (shingle, set) pairs by shingle: where a shingle is shared, its sets stand next to each other
    owner = np.repeat(np.arange(len(sets)), np.diff(cuts))
    by = np.lexsort((owner, codes))
    starts = np.searchsorted(codes[by], np.arange(codes.max() + 2))
    held, sizes, out = owner[by], np.diff(cuts), []
    own = np.array(parts, np.int64)
    for i in range(1, len(sets)):
        if across and not sides[i]:
            other = np.flatnonzero(sides)
        elif across:
            other = np.flatnonzero(~sides[:i])
        else:
            other = np.arange(i)
        other = other[(other < i) & (own[other] != own[i])]
        if not len(other):
            continue
        mine = codes[cuts[i] : cuts[i + 1]]
        common = np.bincount(np.concatenate([held[starts[c] : starts[c + 1]] for c in mine]), minlength=len(sets))[other]
        for j in other[100 * common >= SIMILARITY * (sizes[other] + sizes[i] - common)]:
            a, b = root(parts[i]), root(parts[int(j)])
            if a != b:
                parent[a] = b
                out.append((i, int(j)))
    return out


def _inside_pools(pools: DataFrame, linked: DataFrame, full: DataFrame) -> DataFrame:
    """Links (doc, other) inside pools of several parts.  The members of a pool's largest part are dealt into
    blocks, and so are the others.  Each block of others meets every block, itself too, in a group of its own;
    blocks of the largest part don't meet each other."""
    linked_to = components(linked, "doc", "other")
    parts = linked_to.select(F.col("node"), F.col("component").alias("part"))
    members = pools.withColumnRenamed("node", "doc").join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    members = written(members.join(full.select("doc", "n"), "doc"), "members")
    sizes = members.groupBy("pool", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    largest = sizes.groupBy("pool").agg(F.max(F.struct("sets", "n", "part")).alias("main"), F.sum("sets").alias("sets"), F.sum("n").alias("n")).where("sets > main.sets")
    blocks = lambda sets, n: F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    largest = largest.select(
        "pool", F.col("main.part").alias("main"), blocks(F.col("main.sets"), F.col("main.n")).alias("g"), blocks(F.col("sets") - F.col("main.sets"), F.col("n") - F.col("main.n")).alias("o")
    )
    rows = members.join(largest, "pool")
    is_main, deal = F.col("part") == F.col("main"), lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    rows = rows.withColumn("own", F.when(is_main, F.col("o") + deal("g")).otherwise(deal("o")))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("o")).otherwise(F.col("o") + F.col("g")) - 1)))
    rows = rows.select("pool", "doc", "part", F.least("own", "met").alias("b1"), F.greatest("own", "met").alias("b2"), "own")

    def compare(t):
        first, last = t.column("b1")[0].as_py(), t.column("b2")[0].as_py()
        t = t.take(pa.array(np.argsort(t.column("doc").to_numpy(), kind="stable")))
        ids, sets = t.column("doc").to_pylist(), [np.asarray(v.values) for v in t.column("shingles").combine_chunks()]
        found = forest(ids, sets, [o != first for o in t.column("own").to_pylist()], t.column("part").to_pylist(), first != last)
        return pa.table({"doc": pa.array([ids[i] for i, _ in found], pa.int64()), "other": pa.array([ids[j] for _, j in found], pa.int64())})

    with_sets = rows.join(full.select("doc", "shingles"), "doc")
    out = written(with_sets.groupBy("pool", "b1", "b2").applyInArrow(compare, "doc long, other long"), "inside")
    discard(members, linked_to)
    return out


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, less those that another of their component stands for.  Rows with
    null ids stay."""
    found = near_components(docs, key, text)  # a document goes if one of its rows does
    gone = written(found.where(~F.col("kept") & F.col(key).isNotNull()).select(key).distinct(), "gone")
    discard(found)
    return on(docs.join(gone, key, "left_anti").select(docs.columns), gone)
