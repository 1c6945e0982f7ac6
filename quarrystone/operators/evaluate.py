"""Quality of a run against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_of(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2)


def pairwise(xref: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall over pairs of records; truth: record_key, true_vendor.  Three grouped sums."""
    df = xref.select("record_key", "master_key").join(truth.select("record_key", "true_vendor"), "record_key")
    both = df.groupBy("master_key", "true_vendor").agg(F.count("*").alias("n"))
    by = lambda k: both.groupBy(k).agg(F.sum("n").alias("n"))
    one = both.agg(pairs_of(F.col("n")).alias("correct"))
    two = by("master_key").agg(pairs_of(F.col("n")).alias("predicted"), F.count("*").alias("golden_vendors"))
    three = by("true_vendor").agg(pairs_of(F.col("n")).alias("actual"), F.count("*").alias("true_vendors"))
    out = one.join(F.broadcast(two)).join(F.broadcast(three))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(1.0)
    return out.select(share("correct", "predicted").alias("match_precision"), share("correct", "actual").alias("match_recall"), "golden_vendors", "true_vendors")


def exact_vendors(xref: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_vendor, records): vendors whose records are one golden vendor that holds no others."""
    df = xref.select("record_key", "master_key").join(truth.select("record_key", "true_vendor"), "record_key")
    both = df.groupBy("master_key", "true_vendor").agg(F.count("*").alias("n"))
    pure = both.groupBy("master_key").agg(F.count("*").alias("c")).where("c = 1").select("master_key")
    whole = both.groupBy("true_vendor").agg(F.count("*").alias("c"), F.min("master_key").alias("master_key"), F.sum("n").alias("records")).where("c = 1")
    return whole.join(pure, "master_key").select("true_vendor", "records")


def resolution(xref: DataFrame, truth: DataFrame) -> DataFrame:
    exact = exact_vendors(xref, truth).agg(F.count("*").alias("vendors_exact"), F.count_if(F.col("records") > 1).alias("multi_record_vendors_resolved"))
    known = xref.select("record_key").join(truth.select("record_key", "true_vendor"), "record_key").groupBy("true_vendor").agg(F.count("*").alias("n"))
    every = known.agg(F.count("*").alias("true_vendors"), F.count_if(F.col("n") > 1).alias("multi_record_vendors"))
    return exact.join(F.broadcast(every))  # one row each


def spend_on_exact(spend: DataFrame, invoices: DataFrame, xref: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the spend that lies on exactly resolved vendors."""
    of = invoices.select("record_key", "vendor_record_key").dropDuplicates(["record_key"]).join(truth.select(F.col("record_key").alias("vendor_record_key"), "true_vendor"), "vendor_record_key")
    good = of.join(exact_vendors(xref, truth), "true_vendor", "left_semi").select("record_key").withColumn("_ok", F.lit(True))
    df = spend.join(good, "record_key", "left")
    return df.agg(F.round(F.sum(F.when(F.col("_ok"), F.col("amount_usd")).otherwise(0.0)) / F.sum("amount_usd"), 4).alias("spend_share_exact"))


def catch_rates(flags: DataFrame, defects: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(defect_type, seeded, caught, catch_rate); defects: record_key, expected_rule, defect_type."""
    hit = flags.select("record_key", F.col("rule_id").alias("expected_rule")).distinct().withColumn("_hit", F.lit(True))
    df = defects.where("expected_rule IS NOT NULL").join(hit, ["record_key", "expected_rule"], "left")
    ok = F.coalesce("_hit", F.lit(False))
    if fixed is not None:
        df = df.join(fixed.select("record_key").distinct().withColumn("_fixed", F.lit(True)), "record_key", "left")
        ok = ok | F.coalesce("_fixed", F.lit(False))
    return df.groupBy("defect_type").agg(F.count("*").alias("seeded"), F.sum(ok.cast("long")).alias("caught"), F.round(F.avg(ok.cast("long")), 4).alias("catch_rate"))


def false_quarantine(flags: DataFrame, defects: DataFrame, invoices: DataFrame) -> DataFrame:
    clean = invoices.select("record_key").distinct().join(defects.select("record_key").distinct(), "record_key", "left_anti")
    bad = flags.where("entity = 'invoice'").select("record_key").distinct().withColumn("_bad", F.lit(1))
    return clean.join(bad, "record_key", "left").agg(F.count("*").alias("clean"), F.count("_bad").alias("flagged")).select("clean", "flagged", F.when(F.col("clean") > 0, F.round(F.col("flagged") / F.col("clean"), 4)).otherwise(0.0).alias("false_quarantine_rate"))


def score_share(keys: DataFrame, flags: DataFrame) -> DataFrame:
    """Share of the rows whose key fails nothing."""
    bad = flags.select("record_key").distinct().withColumn("_bad", F.lit(1))
    return keys.select("record_key").join(bad, "record_key", "left").agg(F.round(1 - F.count("_bad") / F.count("*"), 4).alias("dq_score"))
