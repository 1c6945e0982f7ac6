"""Registered queries over the driver's tables, each through the engine's operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.functions import privacy
from quarrystone.functions.similarity import token_sort_ratio
from quarrystone.operators import components, evaluate, golden, learning, library, mapping_learner, matching, patterns, profiling, rules, sentinel, spend, standardize
from quarrystone.operators.rules import ANOMALY, RULES, Rule
from quarrystone.sources import extract
from quarrystone.sources.scratch import new_path, written
from quarrystone.streaming import jobs

AS_OF = config.AS_OF
ALL_RULES = [*RULES, ANOMALY]
INVOICE_RULES = rules.of_entity(ALL_RULES, "invoice")


class Lake:
    """The derived tables of one scale, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: config.Profile = config.LIGHT):
        self.spark, self.sf_dir, self.profile = spark, sf_dir, profile

    def table(self, name: str) -> DataFrame:
        return extract.table(self.spark, self.sf_dir, name)

    @cached_property
    def raw_vendors(self) -> DataFrame:
        return extract.vendors(self.spark, self.sf_dir)

    @cached_property
    def vendors(self) -> DataFrame:
        return standardize.vendors(self.raw_vendors, self.profile.mappings)

    @cached_property
    def invoices(self) -> DataFrame:
        return standardize.invoices(extract.invoices(self.spark, self.sf_dir), self.profile.mappings)

    # The same, written once, for what reads them several times: the extracts are a large projection.
    @cached_property
    def silver_vendors(self) -> DataFrame:
        return written(self.vendors, "silver_vendor")

    @cached_property
    def silver_invoices(self) -> DataFrame:
        return written(self.invoices, "silver_invoice")

    @cached_property
    def context(self) -> DataFrame:
        return rules.with_context(self.silver_invoices, self.silver_vendors)

    @cached_property
    def flags(self) -> DataFrame:
        return rules.failures(self.silver_vendors, self.context, ALL_RULES, AS_OF)

    @cached_property
    def valid(self) -> DataFrame:
        return rules.valid_invoices(self.context, INVOICE_RULES, AS_OF, self.silver_invoices.columns)

    @cached_property
    def scored(self) -> DataFrame:
        return matching.score_pairs(self.silver_vendors, matching.candidate_pairs(self.silver_vendors))

    @cached_property
    def clusters(self) -> DataFrame:
        return components.clusters(self.silver_vendors, self.scored.where("band = 'HIGH'").select("left_key", "right_key"))

    @cached_property
    def gold(self) -> tuple[DataFrame, DataFrame]:
        return golden.build(self.silver_vendors, self.clusters)

    @cached_property
    def spend(self) -> DataFrame:
        return spend.fact(self.valid, self.gold[1])

    @cached_property
    def truth(self) -> DataFrame:
        return self.raw_vendors.select("record_key", "true_vendor")

    @cached_property
    def log(self) -> DataFrame:
        """events as a versioned decision log: user is the item, each event a version."""
        e = self.table("events")
        return e.select(F.concat(F.lit("ITEM:"), "user_id").alias("item_id"), F.col("event_id").alias("library_version"), F.when(F.col("event_type") == "purchase", "retired").otherwise("active").alias("status"), F.col("event_type").alias("note"))


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Lake(spark, sf_dir))
    return build


# --- standardisation and privacy ----------------------------------------------------------------------------------
@query
def std_vendor(lake: Lake) -> DataFrame:
    return lake.vendors


@query
def std_vendor_seed_mappings(lake: Lake) -> DataFrame:
    seed = standardize.vendors(lake.raw_vendors, config.Mappings.seed(), protect=False)
    return seed.select("record_key", "vendor_name_norm", "city", "phone", "email", "bank_account")


@query
def std_many_mappings(lake: Lake) -> DataFrame:
    """Names with a token of each vendor's own, and as many mappings as there are parts: a join if that's many."""
    item = {"domain": F.lit("token"), "raw": F.concat(F.lit("W"), F.col("p_partkey").cast("string")), "canonical": F.concat(F.lit("GROUP"), (F.col("p_partkey") % 100).cast("string"))}
    known = replace(config.Mappings.curated(), table=lake.table("part").select(*(c.alias(n) for n, c in item.items())))
    named = lake.raw_vendors.withColumn("vendor_name", F.concat("vendor_name", F.lit(" W"), "source_vendor_id"))
    return standardize.vendors(named, known).select("record_key", "vendor_name_norm", "city")


@query
def std_invoice(lake: Lake) -> DataFrame:
    return lake.invoices.withColumn("invoice_date", F.col("invoice_date").cast("string"))


@query
def pii_tokens(lake: Lake) -> DataFrame:
    return lake.vendors.select("record_key", "phone", "email", "bank_account", "phone_token", "email_token", "bank_token")


@query
def pii_vault(lake: Lake) -> DataFrame:
    return standardize.vault(lake.raw_vendors)


@query
def pii_leak_audit(lake: Lake) -> DataFrame:
    return privacy.leaking_columns(lake.raw_vendors, standardize.vault(lake.raw_vendors))


@query
def invoice_fixes(lake: Lake) -> DataFrame:
    fixes = [{"id": f"FIX:R07:{s}:currency '(blank)'", "source": s, "raw": "(blank)"} for s in ("ERP_A", "ERP_B")]
    fixes.append({"id": "FIX:R07:*:currency 'XXX'", "source": "*", "raw": "XXX"})
    return standardize.apply_fixes(lake.invoices, lake.vendors, fixes).select("record_key", "currency_raw", "currency", "fixed_by")


# --- rules --------------------------------------------------------------------------------------------------------
@query
def dq_failures(lake: Lake) -> DataFrame:
    return lake.flags


@query
def dq_scorecard(lake: Lake) -> DataFrame:
    return rules.scorecard(lake.silver_vendors, lake.context, ALL_RULES, AS_OF)


@query
def dq_shadow_rules(lake: Lake) -> DataFrame:
    shadow = [replace(r, mode="shadow") if r.id in ("R05", "R07") else r for r in ALL_RULES]
    flags = rules.failures(lake.silver_vendors, lake.context, shadow, AS_OF)
    return flags.groupBy("mode", "rule_id").agg(F.count("*").alias("failing_keys"))


def _custom(lake: Lake, rule: Rule, table: str, key: str) -> DataFrame:
    df = lake.table(table)
    return df.where(rules.fails(rule, AS_OF)).groupBy(F.lit(rule.id).alias("rule_id")).agg(F.count("*").alias("failed"), F.count_distinct(key).alias("failing_keys"))


@query
def dq_range(lake: Lake) -> DataFrame:
    return _custom(lake, Rule("C01", "balance in range", "vendor", "range", "c_acctbal", low=-500, high=9000), "customer", "c_custkey")


@query
def dq_allowed(lake: Lake) -> DataFrame:
    return _custom(lake, Rule("C02", "known segment", "vendor", "allowed_values", "c_mktsegment", values=("BUILDING", "AUTOMOBILE")), "customer", "c_custkey")


@query
def dq_regex(lake: Lake) -> DataFrame:
    return _custom(lake, Rule("C03", "customer name", "vendor", "regex", "c_name", pattern="Customer#0000[0-4]"), "customer", "c_custkey")


@query
def dq_positive(lake: Lake) -> DataFrame:
    return _custom(lake, Rule("C04", "positive balance", "vendor", "positive", "c_acctbal"), "customer", "c_custkey")


@query
def dq_date(lake: Lake) -> DataFrame:
    rule = Rule("C05", "no future order", "invoice", "date_not_future", "day")
    df = lake.table("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    import datetime

    return df.where(rules.fails(rule, datetime.date(1996, 6, 30))).groupBy("o_orderstatus").agg(F.count("*").alias("failed"))


@query
def dq_unique(lake: Lake) -> DataFrame:
    line = lake.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_key"))
    copies = line.groupBy("record_key").agg(F.count("*").alias("copies")).where("copies > 1")
    return copies.groupBy("copies").agg(F.count("*").alias("failing_keys"), F.sum("copies").alias("failed"))


@query
def dq_reference(lake: Lake) -> DataFrame:
    orphans = lake.invoices.join(lake.vendors.select(F.col("record_key").alias("vendor_record_key")), "vendor_record_key", "left_anti")
    return orphans.groupBy("source_system").agg(F.count("*").alias("orphans"))


@query
def a01_outliers(lake: Lake) -> DataFrame:
    return lake.context.where("_is_outlier").select("record_key", "vendor_record_key", "amount")


@query
def a01_events(lake: Lake) -> DataFrame:
    e = lake.table("events").where("value IS NOT NULL")
    limits = rules.outliers(e, 5.0, 3, "user_id", "value")
    return e.join(limits, "user_id").where("value > limit").select("event_id", "user_id", "value", F.round("median", 6).alias("median"))


@query
def rule_preview(lake: Lake) -> DataFrame:
    sentence = "Invoice amount must be at most 1,000"
    found = rules.heuristic_rule(sentence, {"invoice": lake.invoices.columns, "vendor": lake.vendors.columns})
    rule = Rule("C01", mode="shadow", **found)
    rules.validate(rule, lake.invoices.columns)
    return rules.preview(rule, lake.invoices, AS_OF)


@query
def invoice_valid(lake: Lake) -> DataFrame:
    return lake.valid.select("record_key", "vendor_record_key", F.col("invoice_date").cast("string").alias("invoice_date"), "amount", "currency")


@query
def invoice_quarantine(lake: Lake) -> DataFrame:
    return rules.quarantine(lake.context, INVOICE_RULES, AS_OF, ["record_key", "amount", "currency"])


@query
def vendor_dq(lake: Lake) -> DataFrame:
    return rules.vendor_checks(lake.vendors, ALL_RULES, AS_OF)


@query
def source_score(lake: Lake) -> DataFrame:
    return rules.source_scores(lake.silver_vendors, lake.context, ALL_RULES, AS_OF)


@query
def source_score_pivot(lake: Lake) -> DataFrame:
    scores = rules.source_scores(lake.silver_vendors, lake.context, ALL_RULES, AS_OF)
    return scores.groupBy("source_system").pivot("entity", ["vendor", "invoice"]).agg(F.max("score")).select("source_system", F.col("vendor").alias("vendor_score"), F.col("invoice").alias("invoice_score"))


@query
def dq_score(lake: Lake) -> DataFrame:
    keys = lake.silver_vendors.select("record_key").unionByName(lake.silver_invoices.select("record_key"))
    return evaluate.score_share(keys, lake.flags)


# --- spend --------------------------------------------------------------------------------------------------------
@query
def spend_by_country(lake: Lake) -> DataFrame:
    return spend.valid_spend_by_country(lake.context, lake.silver_vendors, rules.failed_ids(INVOICE_RULES, AS_OF))


@query
def spend_certified(lake: Lake) -> DataFrame:
    return lake.spend.select("record_key", "master_key", F.col("invoice_date").cast("string").alias("invoice_date"), "currency", "amount", "amount_usd")


@query
def spend_by_month(lake: Lake) -> DataFrame:
    return spend.by_month(lake.spend)


@query
def top10_vendors(lake: Lake) -> DataFrame:
    return spend.top_vendors(lake.spend, lake.gold[0])


@query
def kpis(lake: Lake) -> DataFrame:
    return spend.kpis(lake.spend, lake.gold[0])


# --- matching -----------------------------------------------------------------------------------------------------
@query
def block_pairs(lake: Lake) -> DataFrame:
    return matching.candidate_pairs(lake.silver_vendors)


@query
def pair_scores(lake: Lake) -> DataFrame:
    return lake.scored


@query
def band_counts(lake: Lake) -> DataFrame:
    return lake.scored.groupBy("band").agg(F.count("*").alias("pairs"))


@query
def match_signatures(lake: Lake) -> DataFrame:
    return lake.scored.groupBy("signature").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query
def guarded_bands(lake: Lake) -> DataFrame:
    even = F.length("left_key") % 2 == 0
    said = F.when(even, "same").when(F.col("score") < 0.6, "different")
    new = matching.guarded_band(F.col("score"), F.col("tax_conflict"), said, F.when(F.col("city_eq"), 0.9).otherwise(0.5))
    return lake.scored.select("left_key", "right_key", "band", new.alias("guarded"))


@query
def review_queue(lake: Lake) -> DataFrame:
    none = lake.spark.createDataFrame([], library.DECISIONS)
    rule = lake.spark.createDataFrame([("tax:missing|name>=0.9|city:y|phone:y|domain:n", "MATCH:1", "match")], "signature string, item_id string, decision string")
    decided = matching.decide(lake.scored, none, rule, any_band=True)
    return decided.groupBy("band", "merge", "decided_by").agg(F.count("*").alias("pairs"))


@query
def name_similarity(lake: Lake) -> DataFrame:
    n = lake.table("nation").select("n_nationkey", "n_name")
    a, b = n.toDF("a_key", "a_name"), n.toDF("b_key", "b_name")
    pairs = a.join(b, F.substring("a_name", 1, 1) == F.substring("b_name", 1, 1))
    return pairs.select("a_key", "b_key", F.round(token_sort_ratio(F.col("a_name"), F.col("b_name")), 6).alias("similarity"))


@query
def cluster_labels(lake: Lake) -> DataFrame:
    return lake.clusters


@query
def golden_vendors(lake: Lake) -> DataFrame:
    return lake.gold[0]


@query
def golden_xref(lake: Lake) -> DataFrame:
    return lake.gold[1]


@query
def cluster_alerts(lake: Lake) -> DataFrame:
    return golden.cluster_alerts(lake.silver_vendors, lake.gold[1])


@query
def cannot_link_clusters(lake: Lake) -> DataFrame:
    edges = lake.scored.where("band <> 'LOW'").select("left_key", "right_key", "score")
    cannot = edges.where(F.substring(F.md5("left_key"), 1, 1).isin("0", "1")).select("left_key", "right_key")  # an eighth
    return components.constrained_clusters(lake.silver_vendors, edges, cannot)[0]


# --- truth --------------------------------------------------------------------------------------------------------
@query
def match_metrics(lake: Lake) -> DataFrame:
    return evaluate.pairwise(lake.gold[1], lake.truth)


@query
def resolution(lake: Lake) -> DataFrame:
    return evaluate.resolution(lake.gold[1], lake.truth)


@query
def spend_on_exact(lake: Lake) -> DataFrame:
    return evaluate.spend_on_exact(lake.spend, lake.silver_invoices, lake.gold[1], lake.truth)


def _defects(lake: Lake) -> DataFrame:
    """What the extract was derived with."""
    o, c = lake.table("orders"), lake.table("customer")
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, config.SOURCES)), (F.col("o_custkey") % 3 + 1).cast("int"))
    key = F.concat(source, F.lit(":INV:INV"), F.lpad(k.cast("string"), 9, "0"))
    kinds = [
        (k % 33 == 2, "R05", "amount_missing"), ((k % 33 != 2) & (k % 25 == 1), "R05", "amount_negative"), (k % 33 == 5, "R06", "date_invalid"), ((k % 33 != 5) & (k % 25 == 4), "R06", "date_future"),
        (k % 20 == 6, "R07", "currency_missing"), (k % 20 == 16, "R07", "currency_unknown"), (k % 20 == 7, "R08", "orphan"), (k % 25 == 8, "R09", "duplicate"), ((k % 25 != 1) & (k % 33 == 3), "A01", "outlier"),
    ]
    rows = F.filter(F.array(*[F.when(w, F.struct(F.lit(r).alias("expected_rule"), F.lit(d).alias("defect_type"))) for w, r, d in kinds]), lambda x: x.isNotNull())
    inv = o.select(key.alias("record_key"), F.explode(rows).alias("x")).select(F.lit("invoice").alias("entity"), "record_key", "x.*")
    v = F.col("c_custkey")
    vs = F.element_at(F.array(*map(F.lit, config.SOURCES)), (v % 3 + 1).cast("int"))
    kinds = [(v % 10 == 3, "R01", "tax_missing"), ((v % 10 != 3) & (v % 17 == 5), "R02", "tax_invalid"), (v % 20 == 11, "R03", "country_invalid"), (v % 12 == 7, "R04", "email_invalid")]
    rows = F.filter(F.array(*[F.when(w, F.struct(F.lit(r).alias("expected_rule"), F.lit(d).alias("defect_type"))) for w, r, d in kinds]), lambda x: x.isNotNull())
    return inv.unionByName(c.select(F.concat(vs, F.lit(":"), v.cast("string")).alias("record_key"), F.explode(rows).alias("x")).select(F.lit("vendor").alias("entity"), "record_key", "x.*"))


@query
def catch_rate(lake: Lake) -> DataFrame:
    return evaluate.catch_rates(lake.flags, _defects(lake))


@query
def false_quarantine(lake: Lake) -> DataFrame:
    return evaluate.false_quarantine(lake.flags, _defects(lake).where("entity = 'invoice'"), lake.silver_invoices)


# --- profiles, patterns, library ----------------------------------------------------------------------------------
@query
def profile_shapes(lake: Lake) -> DataFrame:
    return profiling.profile(lake.silver_vendors, "silver_vendor", ["vendor_name", "country_raw", "tax_id", "city", "email_domain"])


@query
def token_vocab(lake: Lake) -> DataFrame:
    return profiling.vocabulary(lake.table("part"), "p_name")


@query
def learned_tokens(lake: Lake) -> DataFrame:
    return profiling.learn_tokens(lake.raw_vendors, "vendor_name", config.Mappings.seed())


@query
def learned_mappings(lake: Lake) -> DataFrame:
    """All three domains, from canonical values only."""
    found = mapping_learner.learn(lake.raw_vendors, extract.invoices(lake.spark, lake.sf_dir), config.Mappings.seed())
    return found.withColumn("options", F.array_join("options", "|")).drop("reason")


@query
def learned_abbreviations(lake: Lake) -> DataFrame:
    """Tokens, where industries are written out but for one vendor in a hundred."""
    vendors = lake.raw_vendors.withColumn("vendor_name", F.expr(extract.SPELLED_SQL))
    found = mapping_learner.learn(vendors, extract.invoices(lake.spark, lake.sf_dir), config.Mappings.seed()).where("domain = 'token'")
    return found.withColumn("options", F.array_join("options", "|")).drop("reason")


@query
def mapping_patterns(lake: Lake) -> DataFrame:
    found = mapping_learner.learn(lake.raw_vendors, extract.invoices(lake.spark, lake.sf_dir), config.Mappings.seed())
    return patterns.mapping_patterns(found.where(~F.col("approved")))


@query
def unmapped_cities(lake: Lake) -> DataFrame:
    return profiling.unmapped(lake.raw_vendors, "city_raw", config.Mappings.seed(), "city")


@query
def dq_patterns(lake: Lake) -> DataFrame:
    return patterns.dq_patterns(lake.flags, lake.silver_vendors, lake.silver_invoices, ALL_RULES).select("pattern_id", "kind", "rule_id", "source_system", "signature", "affected_records")


@query
def match_patterns(lake: Lake) -> DataFrame:
    return patterns.match_patterns(lake.scored)


@query
def pattern_coverage(lake: Lake) -> DataFrame:
    found = patterns.dq_patterns(lake.flags, lake.silver_vendors, lake.silver_invoices, ALL_RULES).select("pattern_id", "affected_records")
    return patterns.coverage(found.unionByName(patterns.match_patterns(lake.scored).select("pattern_id", "affected_records")))


@query
def library_active(lake: Lake) -> DataFrame:
    last = matching.latest(lake.log, ["item_id"], ["library_version"])
    return last.where("status = 'active'").select("item_id", "library_version", "note")


_WATCHED = [sentinel.AlertRule("AL02", "spike", "n", "rise_vs_previous", 5, "medium"), sentinel.AlertRule("AL01", "drop", "n", "drop_vs_previous", 5, "high"), sentinel.AlertRule("AL03", "low", "n", "below", 3, "high")]


def _daily_events(lake: Lake) -> DataFrame:
    daily = lake.table("events").groupBy(F.date_trunc("day", "ts").alias("run_at"), F.col("event_type").alias("object")).agg(F.count("*").cast("double").alias("value"))
    return daily.withColumn("metric", F.lit("n"))


@query
def run_delta_alerts(lake: Lake) -> DataFrame:
    return sentinel.history_alerts(_daily_events(lake), _WATCHED)


@query
def stream_alerts(lake: Lake) -> DataFrame:
    """The same as a stream of three deliveries, and a row of a year later, which lets the watermark pass the last day."""
    daily, folder = written(_daily_events(lake), "daily"), new_path(lake.spark, "deliveries")
    first, last = daily.agg(F.min("run_at"), F.max("run_at")).first()
    if first is not None:
        third = F.floor(3 * F.date_diff("run_at", F.lit(first)) / F.lit((last - first).days + 1))
        for n in range(3):
            daily.where(third == n).write.mode("append").parquet(folder)
        closing = daily.agg((F.max("run_at") + F.expr("INTERVAL 365 DAYS")).alias("run_at"), F.lit("").alias("object"), F.lit(0.0).alias("value"), F.lit("").alias("metric"))
        closing.write.mode("append").parquet(folder)
    else:
        daily.write.parquet(folder)
    stream = lake.spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    out = new_path(lake.spark, "alerts")
    alerts = jobs.change_alerts(stream, _WATCHED, "1 hour")
    jobs.into_table(alerts, out, new_path(lake.spark, "checkpoint")).awaitTermination()
    return lake.spark.read.schema(alerts.schema).parquet(out)


@query
def run_metrics(lake: Lake) -> DataFrame:
    card = rules.scorecard(lake.silver_vendors, lake.context, ALL_RULES, AS_OF)
    bad = rules.quarantine(lake.context, INVOICE_RULES, AS_OF, ["record_key"])
    return sentinel.run_metrics(lake.silver_vendors, lake.silver_invoices, lake.flags, card, bad, golden.cluster_alerts(lake.silver_vendors, lake.gold[1]))


@query
def train_matcher(lake: Lake) -> DataFrame:
    truth = lambda s: lake.truth.select(F.col("record_key").alias(f"{s}_key"), F.col("true_vendor").alias(f"_{s}"))
    told = lake.scored.where("band = 'MEDIUM'").join(truth("left"), "left_key").join(truth("right"), "right_key")
    told = told.select("left_key", "right_key", F.when(F.col("_left") == F.col("_right"), "match").otherwise("no_match").alias("decision"), F.lit("truth").alias("reviewer"), F.lit("").alias("note"), F.lit(AS_OF).cast("timestamp").alias("decided_at"))
    got = learning.train_matcher(learning.training_set(lake.scored, told))
    return lake.spark.createDataFrame([(got["trained"], got.get("precision"), got.get("recall"))], "trained boolean, precision double, recall double")


@query
def isolation_forest(lake: Lake) -> DataFrame:
    df = lake.invoices.where("amount > 0").withColumn("log_amount", F.log1p("amount"))
    median = rules.outliers(lake.invoices, 1.0, 1).select("vendor_record_key", "median")
    df = df.join(median, "vendor_record_key", "left").withColumn("ratio", F.coalesce(F.col("amount") / F.col("median"), F.lit(1.0)))
    return learning.isolation_scores(df, ["log_amount", "ratio"], ["record_key"])


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
