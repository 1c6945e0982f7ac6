"""Root-cause patterns: many issues, few decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.text import source_of
from quarrystone.operators.rules import Rule


def pattern_id(item: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(F.sha1(item.cast("binary")), 1, 10))


def failure_signature() -> Column:
    """The cause of a failure, coarse enough that one decision covers the group; null fields are those of the
    other entity."""
    rule, tax = F.col("rule_id"), F.length(F.coalesce("tax_id", F.lit("")))
    quoted = lambda head, c: F.concat(F.lit(f"{head} '"), F.coalesce(F.nullif(c, F.lit("")), F.lit("(blank)")), F.lit("'"))
    return (
        F.when(rule == "R01", "tax ID missing")
        .when(rule == "R02", F.when(tax < 12, "tax ID too short").when(tax > 12, "tax ID too long").otherwise("tax ID bad characters"))
        .when(rule == "R03", quoted("country", F.col("country_raw")))
        .when(rule == "R04", "email without a valid domain")
        .when(rule == "R05", F.when(F.col("amount").isNull(), "amount missing").otherwise("amount zero or negative"))
        .when(rule == "R06", F.when(F.col("invoice_date").isNull(), "date unparseable").otherwise("date in the future"))
        .when(rule == "R07", quoted("currency", F.upper(F.trim("currency_raw"))))
        .when(rule == "R08", "vendor ID not in vendor master")
        .when(rule == "R09", "duplicate invoice number")
        .when(rule == "A01", "amount over 20x the vendor's median")
        .otherwise("fails custom rule")
    )


def attributed(flags: DataFrame, vendors: DataFrame, invoices: DataFrame) -> DataFrame:
    """flags with what signatures need of their records (one row for each key)."""
    v = vendors.groupBy("record_key").agg(F.min("tax_id").alias("tax_id"), F.min("country_raw").alias("country_raw"))
    i = invoices.groupBy("record_key").agg(F.min("amount").alias("amount"), F.min("invoice_date").alias("invoice_date"), F.min("currency_raw").alias("currency_raw"))
    return flags.join(v, "record_key", "left").join(i, "record_key", "left")


def dq_patterns(flags: DataFrame, vendors: DataFrame, invoices: DataFrame, rules: list[Rule], acknowledged: list[str] = ()) -> DataFrame:
    """A pattern for each rule, source (fixes only) and signature, with its proposed item."""
    df = attributed(flags.where("mode = 'enforce'"), vendors, invoices).withColumn("signature", failure_signature())
    fixable = (F.col("rule_id") == "R07") & (F.col("signature") != "currency 'XXX'")
    df = df.withColumn("source_system", F.when(fixable, source_of(F.col("record_key"))).otherwise("*"))
    first = F.slice(F.array_sort(F.collect_set("record_key")), 1, 5)
    keys = df.select("rule_id", "source_system", "signature", "record_key").distinct()
    # Five sample keys: the smallest of each task meet, not all of them.
    ranked = keys.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id", "source_system", "signature").orderBy("record_key"))).where("_n <= 5")
    samples = ranked.groupBy("rule_id", "source_system", "signature").agg(F.to_json(first).alias("sample_keys"))
    counts = keys.groupBy("rule_id", "source_system", "signature").agg(F.count("*").alias("affected_records"))
    fix = (F.col("rule_id") == "R07") & (F.col("source_system") != "*")
    item = F.concat(F.when(fix, "FIX:").otherwise("ACK:"), F.col("rule_id"), F.lit(":"), F.col("source_system"), F.lit(":"), F.col("signature"))
    out = counts.join(samples, ["rule_id", "source_system", "signature"]).withColumn("item_id", item).where(~F.col("item_id").isin(list(acknowledged)) if acknowledged else F.lit(True))
    names = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.name)])
    proposed = F.to_json(F.struct(F.col("affected_records"), F.col("item_id"), F.when(fix, "record_fix").otherwise("acknowledge").alias("kind")))
    return out.select(
        pattern_id(F.col("item_id")).alias("pattern_id"), F.when(fix, "record_fix").otherwise("acknowledge").alias("kind"), "item_id", "rule_id", "source_system", "signature", "affected_records",
        proposed.alias("proposed_item"), "sample_keys", F.coalesce(names[F.col("rule_id")], F.col("rule_id")).alias("evidence"), F.when(fix, 0.8).otherwise(1.0).alias("confidence"),
    )


def match_patterns(pairs: DataFrame) -> DataFrame:
    """Middle-band pairs by signature, with the decision proposed for all of them."""
    open_pairs = pairs.where("band = 'MEDIUM'")
    same = F.avg(F.when(F.col("ai_decision") == "same", 1.0).when(F.col("ai_decision").isNotNull(), 0.0)) if "ai_decision" in pairs.columns else F.lit(None).cast("double")
    g = open_pairs.groupBy("signature").agg(F.count("*").alias("affected_records"), F.avg("score").alias("mean"), same.alias("same"))
    decision = F.when(F.coalesce(F.col("same") >= 0.5, F.col("mean") >= 0.8), "match").otherwise("no_match")
    item = F.concat(F.lit("MATCH:"), "signature")
    return g.select(pattern_id(item).alias("pattern_id"), F.lit("match_rule").alias("kind"), item.alias("item_id"), "signature", "affected_records", decision.alias("decision"), F.round(F.coalesce("same", "mean"), 3).alias("confidence"))


#: Values that fewer records have than this are kept as they are, in one bundle.
TAIL_RECORDS = 5


def bundled(proposals: DataFrame) -> DataFrame:
    """proposals (domain, raw, canonical, confidence, affected, source) with the signature of their pattern and
    asks (whether a steward has to give the value).  Currencies without a proposal are left to their rule."""
    band = F.when(F.col("confidence") >= 0.75, "confident").otherwise("uncertain")
    asks = F.col("canonical").isNull() & (F.col("affected") >= TAIL_RECORDS)
    signature = F.when(asks, F.concat_ws(":", "domain", "raw")).when(F.col("canonical").isNull(), "TAIL").otherwise(F.concat_ws(":", F.lit("BATCH"), "domain", "source", band))
    return proposals.where("canonical IS NOT NULL OR domain <> 'currency'").withColumns({"signature": signature, "asks": asks})


def mapping_patterns(proposals: DataFrame) -> DataFrame:
    """proposals: domain, raw, canonical, confidence, affected, source.  Bundles of proposals with a target, one
    bundle of rare values without, and single questions."""
    sure = F.when(F.col("asks"), 0.0).when(F.col("signature") == "TAIL", 1.0).otherwise(F.col("confidence"))
    raws = F.array_join(F.array_sort(F.collect_set("raw")), ",")
    out = bundled(proposals).groupBy("signature", "asks").agg(raws.alias("raws"), F.count("*").alias("items"), F.sum("affected").alias("affected_records"), F.round(F.avg(sure), 3).alias("confidence"))
    item = F.when(F.col("asks"), F.concat(F.lit("MAP:"), "signature")).otherwise(F.concat("signature", F.lit(":"), "raws"))
    kind = F.when(F.col("asks"), "value_mapping").otherwise("mapping_batch")
    return out.select(pattern_id(item).alias("pattern_id"), kind.alias("kind"), "signature", "items", "affected_records", "confidence", F.col("asks").alias("needs_input"))


def mapping_items(proposals: DataFrame, found: DataFrame) -> DataFrame:
    """What each of the mapping patterns found would put into the library: pattern_id, kind, domain, raw, canonical
    (a rare value stands for itself, a question has none), confidence, affected, source, options."""
    rows = bundled(proposals).join(found.select("signature", "pattern_id", "kind"), "signature")
    tail = F.col("signature") == "TAIL"
    return rows.select("pattern_id", "kind", "domain", "raw", F.when(tail, F.col("raw")).otherwise(F.col("canonical")).alias("canonical"), F.when(tail, 1.0).otherwise(F.col("confidence")).alias("confidence"), "affected", "source", "options")


def coverage(patterns: DataFrame, top: int = 10) -> DataFrame:
    """open_patterns, issues_in_patterns and the share of the largest ones; patterns are few, the ranking is a
    top-k."""
    best = patterns.orderBy(F.desc("affected_records"), "pattern_id").limit(top).agg(F.sum("affected_records").alias("best"))
    total = patterns.agg(F.count("*").alias("open_patterns"), F.coalesce(F.sum("affected_records"), F.lit(0)).alias("issues_in_patterns"))
    share = F.when(F.col("issues_in_patterns") > 0, F.round(F.col("best") / F.col("issues_in_patterns"), 4)).otherwise(1.0)
    return total.join(F.broadcast(best)).select("open_patterns", "issues_in_patterns", share.alias("top_coverage"))  # one row each


def open_patterns(parts: list[DataFrame], decisions: DataFrame, acknowledged: list[str] = ()) -> DataFrame:
    """Patterns of all kinds without a decision, most affected records first."""
    cols = ["pattern_id", "kind", "signature", "affected_records", "confidence"]
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out.join(decisions.select("pattern_id").distinct(), "pattern_id", "left_anti").orderBy(F.desc("affected_records"), "pattern_id")
