"""Master keys, surviving attributes, cross references and consistency alerts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import config
from quarrystone.functions.similarity import token_sort_ratio
from quarrystone.operators.matching import valid_tax
from quarrystone.operators.nearest import common
from quarrystone.sources.scratch import discard, on, written

#: Names less alike are an alert; names of a vendor that meet in a join of pairs, and of a block of many.
DISSIMILAR, FEW_NAMES, NAMES_BLOCK = 0.6, 64, 512
GOLD_COLUMNS = ("master_key", "vendor_name", "vendor_name_norm", "tax_id", "country_iso2", "city", "street", "phone", "email", "bank_account", "phone_token", "email_token", "bank_token", "source_systems", "member_count")


def assign_master_keys(clusters: DataFrame, previous: DataFrame | None = None, issued: DataFrame | None = None) -> DataFrame:
    """(cluster, master_key).  Clusters, largest first and then by name, each take the key that most of their
    records had and that no earlier cluster took (ties: the smaller key); the others get new numbers in that order.
    previous: record_key, master_key as they were last; issued: master_key of all runs (else previous), so that no number
    is given out twice."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    base = 0
    taken = None
    if previous is not None:
        number = F.regexp_extract("master_key", "([0-9]+)$", 1).cast("long")
        base = (previous if issued is None else issued).agg(F.coalesce(F.max(number), F.lit(0).cast("long"))).first()[0]
        votes = clusters.join(previous.dropDuplicates(["record_key"]), "record_key").groupBy("cluster", "master_key").agg(F.count("*").alias("votes"))
        votes = written(votes.join(size, "cluster"), "votes")
        taken = settled_keys(votes)
    rest = size if taken is None else size.join(taken, "cluster", "left_anti")
    numbered = numbered_rows(rest, [F.desc("n"), F.asc("cluster")])
    new = numbered.select("cluster", F.concat(F.lit(config.MASTER_KEY_PREFIX), F.lpad((F.col("_no") + base).cast("string"), 6, "0")).alias("master_key"))
    return new if taken is None else taken.unionByName(new)


def settled_keys(votes: DataFrame) -> DataFrame:
    """(cluster, master_key) from votes (cluster, master_key, votes, n), by deferred acceptance: each cluster asks for
    the key with most votes that hasn't refused it, each key keeps the first of those who ask (by size, then
    name) and refuses everybody behind that one for good.  As all keys rank clusters alike, the end is what comes of
    letting the clusters choose one after the other.  A round is two grouped minima and a join; a key that
    everybody wants, or a cluster that wants every key, is combined ahead of the shuffle."""
    left, n = votes, votes.count()
    rank = F.struct((-F.col("n")).alias("size"), "cluster")
    while True:
        asks = left.groupBy("cluster").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "master_key"))["master_key"].alias("master_key"), F.first("n").alias("n"))
        kept = asks.groupBy("master_key").agg(F.min(rank).alias("_first"))
        old, left = left, written(left.join(kept, "master_key", "left").where(F.col("_first").isNull() | (rank <= F.col("_first"))).drop("_first"), "votes")
        discard(old)
        before, n = n, left.count()
        if n == before:
            return left.groupBy("cluster").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "master_key"))["master_key"].alias("master_key"))


def numbered_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _no, 1, 2, ... in a total order, without a window over everything: rows are range-partitioned, sorted
    and numbered inside each partition; only the partitions' sizes are added up in one place."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row for each partition: as small as the number of tasks.
    out = ranged.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_no", F.col("_before") + F.col("_at"))
    return on(out.drop("_part", "_before", "_at"), ranged)


def ranked_members(vendors: DataFrame, keys: DataFrame) -> DataFrame:
    """vendors with master_key and _rank, a struct that orders a golden vendor's members."""
    priority = F.create_map(*[F.lit(x) for kv in config.SOURCE_PRIORITY.items() for x in kv])
    return vendors.join(keys, "record_key").withColumn("_rank", F.struct(F.coalesce(priority[F.col("source_system")], F.lit(99)).alias("p"), F.col("record_key").alias("k")))


def first_valid(c: str, valid: Column | None = None) -> Column:
    ok = F.col(c).isNotNull() & (F.col(c) != "")
    ok = ok if valid is None else ok & valid
    return F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("_rank")))


def most_frequent(members: DataFrame, fields: dict[str, Column | None]) -> DataFrame:
    """(master_key, fields): the most frequent valid value of each field, ties to the one that ranks first; null if
    there is none.  fields: a condition or None for each.  All fields go through the same two aggregations."""
    ok = lambda c, valid: F.col(c).isNotNull() & (F.col(c) != "") & (F.lit(True) if valid is None else valid)
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.when(ok(c, valid), F.col(c)).alias("value")) for c, valid in fields.items()])
    said = members.select("master_key", "_rank", F.explode(values).alias("x")).select("master_key", "_rank", "x.field", "x.value")
    counts = said.groupBy("master_key", "field", "value").agg(F.count("value").alias("n"), F.min("_rank").alias("r"))
    best = F.struct((-F.col("n")).alias("n"), "r", "value")
    return counts.groupBy("master_key").agg(*[F.min(F.when((F.col("field") == c) & F.col("value").isNotNull(), best))["value"].alias(c) for c in fields])


def build(vendors: DataFrame, clusters: DataFrame, previous: DataFrame | None = None, issued: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """gold_vendor and gold_vendor_xref."""
    keys = clusters.join(assign_master_keys(clusters, previous, issued), "cluster").select("record_key", "master_key")
    members = written(ranked_members(vendors, keys), "members")
    modes = most_frequent(members, {"vendor_name_norm": None, "tax_id": valid_tax(F.col("tax_id")), **dict.fromkeys(("country_iso2", "city", "phone_token", "email_token", "bank_token"))})
    email_ok = F.col("email").rlike(config.EMAIL_PATTERN)
    named = members.join(modes.select("master_key", F.col("vendor_name_norm").alias("_norm")), "master_key", "left")
    usual = F.col("vendor_name_norm") == F.col("_norm")
    first = named.groupBy("master_key").agg(
        F.coalesce(F.min_by(F.when(usual, F.col("vendor_name")), F.when(usual, F.col("_rank"))), first_valid("vendor_name")).alias("vendor_name"),
        first_valid("street").alias("street"),
        first_valid("phone").alias("phone"),
        first_valid("email", email_ok).alias("email"),
        first_valid("bank_account").alias("bank_account"),
        F.array_join(F.array_sort(F.collect_set("source_system")), ",").alias("source_systems"),
        F.count("*").alias("member_count"),
    )
    xref = members.select("master_key", "record_key", "source_system", "source_vendor_id")
    return first.join(modes, "master_key").select(*GOLD_COLUMNS), xref


def _indel(masks: dict[str, int], size: int, other: str) -> int:
    """Letters to delete and insert to make one word of the other: a metric."""
    return size + len(other) - 2 * common(masks, size, other)


def _masks(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, letter in enumerate(word):
        out[letter] = out.get(letter, 0) | 1 << i
    return out


def least_similar(first: list[str], second: list[str] | None, pivot: str, below: float) -> float | None:
    """The smallest similarity (four decimals) of a word of first and one of second, or of two words of first, if it
    is below that number.  Letter edits are a metric, so the distances of both words to a pivot bound their own distance
    from above; pairs are taken by that bound, and once it allows no less than the best, nothing behind it can."""
    own = _masks(pivot)
    away = lambda words: np.array([_indel(own, len(pivot), w) for w in words], np.int64)
    size = lambda words: np.array([len(w) for w in words], np.int64)
    one, other = first, first if second is None else second
    total = size(one)[:, None] + size(other)[None, :]
    bound = 1 - np.minimum(total, away(one)[:, None] + away(other)[None, :]) / np.maximum(total, 1)
    if second is None:
        bound[np.tril_indices(len(one))] = 2.0
    places = np.argwhere(bound < below)
    places = places[np.argsort(bound[places[:, 0], places[:, 1]], kind="stable")]
    best, masks = below, {}
    for i, j in places.tolist():
        if bound[i, j] >= best:
            break
        mine = masks.get(i) or masks.setdefault(i, _masks(one[i]))
        n = len(one[i]) + len(other[j])
        best = min(best, round(1 - _indel(mine, len(one[i]), other[j]) / n, 4) if one[i] and other[j] else 0.0)
    return best if best < below else None


def _worst_in_blocks(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """(master_key, worst) of vendors with many names (master_key, name; sizes: master_key, n, pivot): blocks of about
    NAMES_BLOCK names meet each other and themselves, each two in a group of their own."""
    blocks = F.ceil(F.col("n") / NAMES_BLOCK).cast("int")
    rows = names.join(sizes.withColumn("blocks", blocks), "master_key").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("master_key", F.least("own", "met").alias("b1"), F.greatest("own", "met").alias("b2"), "own", "name", "pivot")

    def compare(t: pa.Table) -> pa.Table:
        first = t["b1"][0].as_py()
        one = sorted(n for n, o in zip(t["name"].to_pylist(), t["own"].to_pylist(), strict=True) if o == first)
        two = sorted(n for n, o in zip(t["name"].to_pylist(), t["own"].to_pylist(), strict=True) if o != first)
        worst = least_similar(one, two if t["b2"][0].as_py() != first else None, t["pivot"][0].as_py(), DISSIMILAR)
        found = [] if worst is None else [worst]
        return pa.table({"master_key": pa.array([t["master_key"][0].as_py()][: len(found)], pa.string()), "worst": pa.array(found, pa.float64())})

    return rows.groupBy("master_key", "b1", "b2").applyInArrow(compare, "master_key string, worst double").groupBy("master_key").agg(F.min("worst").alias("worst"))


def cluster_alerts(vendors: DataFrame, xref: DataFrame, few_names: int = FEW_NAMES) -> DataFrame:
    """Golden vendors that look like false merges: several valid tax ids or countries or bank accounts, or names far
    apart with nothing else in common.  The names of a vendor are compared by pairs if there are few; the least
    similar two of many are searched for in blocks, so none are gathered in one row."""
    m = vendors.join(xref.select("master_key", "record_key"), "record_key")
    facts = m.groupBy("master_key").agg(
        F.count("*").alias("member_count"),
        F.count_distinct(F.when(valid_tax(F.col("tax_id")), F.col("tax_id"))).alias("taxes"),
        (F.min("country_iso2") != F.max("country_iso2")).alias("countries"),
        F.coalesce(F.min("bank_token") != F.max("bank_token"), F.lit(False)).alias("banks"),
        F.max("bank_token").isNull().alias("no_bank"),
        F.array_join(F.array_sort(F.collect_list("record_key")), ",").alias("members"),
    ).where("member_count > 1")
    names = m.select("master_key", F.replace("vendor_name_norm", F.lit(" "), F.lit("")).alias("name")).where("name IS NOT NULL").distinct()
    names = written(names.join(facts.select("master_key"), "master_key", "left_semi"), "names")
    sizes = names.groupBy("master_key").agg(F.count("*").alias("n"), F.min("name").alias("pivot")).where("n > 1")
    small = names.join(sizes.where(F.col("n") <= few_names).select("master_key"), "master_key")
    pairs = small.withColumnRenamed("name", "a").join(small.withColumnRenamed("name", "b"), "master_key").where("a < b")
    worst = pairs.groupBy("master_key").agg(F.min(F.round(token_sort_ratio(F.col("a"), F.col("b")), 4)).alias("worst"))
    large = sizes.where(F.col("n") > few_names)
    if not large.isEmpty():
        worst = worst.unionByName(_worst_in_blocks(names, large))
    df = facts.join(worst, "master_key", "left")
    issues = F.concat_ws(
        "; ",
        F.when(F.col("taxes") > 1, F.concat(F.col("taxes").cast("string"), F.lit(" different valid tax IDs"))),
        F.when(F.col("countries"), "members in different countries"),
        F.when(F.col("banks"), "different bank accounts"),
        F.when((F.col("worst") < DISSIMILAR) & (F.col("taxes") != 1) & (F.col("banks") | F.col("no_bank")), F.concat(F.lit("dissimilar names (similarity "), F.format_string("%.2f", "worst"), F.lit(") and no shared tax ID or bank account"))),
    )
    return on(df.select("master_key", issues.alias("issues"), "members", "member_count").where("issues <> ''"), names)
