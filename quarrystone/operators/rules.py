"""Data-quality rules: one declaration gives a Column and portable SQL; all row rules run in one scan."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import config
from quarrystone.functions.text import constraint_name, source_of, sql_literal
from quarrystone.sources.scratch import discard, written

#: Amounts of a vendor whose median is taken in one task; parts of a histogram.
HOT_ROWS, MEDIAN_BUCKETS = 1 << 18, 1 << 12


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    entity: str  # vendor or invoice
    type: str
    column: str
    dimension: str = "validity"
    severity: str = "medium"
    pattern: str | None = None
    skip_null: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    mode: str = "enforce"  # or shadow: reported, never blocking


# The rule catalogue.
RULES = (
    Rule("R01", "Vendor tax ID is present", "vendor", "not_null", "tax_id", "completeness", "high"),
    Rule("R02", "Vendor tax ID has a valid format", "vendor", "regex", "tax_id", "validity", "high", config.TAX_ID_PATTERN, True),
    Rule("R03", "Vendor country is a valid ISO code", "vendor", "not_null", "country_iso2", "validity", "medium"),
    Rule("R04", "Vendor email has a valid format", "vendor", "regex", "email", "validity", "low", config.EMAIL_PATTERN, True),
    Rule("R05", "Invoice amount is present and positive", "invoice", "positive", "amount", "validity", "high"),
    Rule("R06", "Invoice date is valid and not in the future", "invoice", "date_not_future", "invoice_date", "timeliness", "high"),
    Rule("R07", "Invoice currency is a supported ISO code", "invoice", "allowed_values", "currency", "validity", "medium", values=("INR", "USD", "GBP", "EUR", "SGD")),
    Rule("R08", "Invoice vendor exists in the vendor master", "invoice", "reference", "vendor_record_key", "consistency", "high"),
    Rule("R09", "Invoice number is unique per source", "invoice", "unique", "record_key", "uniqueness", "high"),
)
ANOMALY = Rule("A01", "Invoice amount far above the vendor's median", "invoice", "anomaly", "amount", "accuracy", "medium")
CUSTOM_TYPES = ("not_null", "regex", "positive", "date_not_future", "range", "allowed_values", "unique")


def fails(rule: Rule, as_of: date) -> Column:
    """True where a record fails.  reference, unique and anomaly read the columns that `with_context` adds."""
    c = F.col(rule.column)
    if rule.type == "not_null":
        out = c.isNull()
    elif rule.type == "regex":
        bad = ~F.coalesce(c, F.lit("")).rlike(f"^(?:{rule.pattern})")
        out = c.isNotNull() & bad if rule.skip_null else bad
    elif rule.type == "positive":
        out = c.isNull() | (c <= 0)
    elif rule.type == "date_not_future":
        out = c.isNull() | (c > F.lit(as_of))
    elif rule.type == "range":
        n = c.try_cast("double")
        out = n.isNull() | F.isnan(n)
        out = out if rule.low is None else out | (n < rule.low)
        out = out if rule.high is None else out | (n > rule.high)
    elif rule.type == "allowed_values":
        out = c.isNull() | ~c.isin(*rule.values)
    elif rule.type == "reference":
        out = ~F.col("_vendor_exists")
    elif rule.type == "unique":
        out = F.col("_copies") > 1
    elif rule.type == "anomaly":
        out = F.col("_is_outlier")
    else:
        raise ValueError(f"unknown rule type {rule.type}")
    return F.coalesce(out, F.lit(True) if rule.type == "regex" else F.lit(False))


def check_sql(rule: Rule, as_of: str = "current_date()") -> str:
    """The same rule as an SQL condition that holds for good records, for constraints in views."""
    c, q = rule.column, sql_literal
    if rule.type == "not_null":
        return f"{c} IS NOT NULL"
    if rule.type == "regex":
        match = f"{c} RLIKE {q('^(?:' + rule.pattern.replace(chr(92), chr(92) * 2) + ')')}"
        return f"({c} IS NULL OR {match})" if rule.skip_null else f"({c} IS NOT NULL AND {match})"
    if rule.type == "positive":
        return f"({c} IS NOT NULL AND {c} > 0)"
    if rule.type == "date_not_future":
        return f"({c} IS NOT NULL AND {c} <= {as_of})"
    if rule.type == "range":
        n = f"try_cast({c} AS DOUBLE)"
        return " AND ".join([f"{n} IS NOT NULL", *([f"{n} >= {rule.low}"] if rule.low is not None else []), *([f"{n} <= {rule.high}"] if rule.high is not None else [])])
    if rule.type == "allowed_values":
        return f"({c} IS NOT NULL AND {c} IN ({', '.join(map(q, rule.values))}))"
    return {"reference": "_vendor_exists", "unique": "_copies = 1", "anomaly": "NOT coalesce(_is_outlier, FALSE)"}[rule.type]


def validate(rule: Rule, columns: list[str]) -> None:
    """Reject what a custom rule mustn't be."""
    if rule.type not in CUSTOM_TYPES:
        raise ValueError(f"type {rule.type} isn't open to custom rules")
    if rule.column not in columns:
        raise ValueError(f"no column {rule.column}")
    if rule.type == "regex":
        re.compile(rule.pattern or "(")
    if rule.type == "range" and rule.low is None and rule.high is None:
        raise ValueError("a range needs a bound")
    if rule.type == "allowed_values" and not rule.values:
        raise ValueError("allowed_values needs values")


def outliers(invoices: DataFrame, multiplier: float = config.ANOMALY_MULTIPLIER, least: int = config.ANOMALY_MIN_HISTORY, vendor: str = "vendor_record_key", amount: str = "amount", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(vendor, median, history) of vendors with enough positive amounts.  An exact percentile keeps a count for each
    distinct value in one task; vendors of more than hot_rows amounts are counted first and go to `hot_medians`."""
    positive = invoices.where((F.col(amount) > 0) & F.col(vendor).isNotNull()).select(vendor, amount)
    history = positive.groupBy(vendor).agg(F.count("*").alias("history")).where(F.col("history") >= least)
    hot = written(history.where(F.col("history") > hot_rows), "hot")
    usual = positive if hot.isEmpty() else positive.join(hot.select(vendor), vendor, "left_anti")
    stats = usual.groupBy(vendor).agg(F.percentile(amount, F.lit(0.5)).alias("median"), F.count("*").alias("history")).where(F.col("history") >= least)
    if usual is not positive:
        counts = positive.join(hot.select(vendor), vendor, "left_semi").groupBy(vendor, amount).agg(F.count("*").alias("n"))
        stats = stats.unionByName(hot_medians(counts, vendor, amount).join(hot, vendor))
    return stats.withColumn("limit", F.col("median") * multiplier)


def hot_medians(counts: DataFrame, key: str, value: str, buckets: int = MEDIAN_BUCKETS) -> DataFrame:
    """(key, median) from counts (key, value, n) of distinct values, by refining histograms.  Infinity ranks last.

    A pass cuts each key's range into so many equal parts, counts them, and keeps the part or two that hold the middle
    ranks with the number of rows below; it ends when no range holds more distinct values than a histogram has parts.
    Then these are ranked.  No task ever holds more than that many rows of a key, and rows are only read again where the
    ranges they fall into go on."""
    largest = F.lit(sys.float_info.max)
    mine = written(counts.select(F.col(key).alias("_key"), F.least(F.col(value), largest).alias("_value"), "n"), "counts")
    whole = mine.groupBy("_key").agg(F.min("_value").alias("lo"), F.max("_value").alias("hi"), F.lit(0).cast("long").alias("below"), F.sum("n").alias("total"), F.count("*").alias("values"))
    whole = whole.withColumn("first", F.floor((F.col("total") - 1) / 2)).withColumn("last", F.ceil((F.col("total") - 1) / 2))  # ranks from 0
    ranges = written(whole.drop("total"), "ranges")
    along = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("_value").between(F.col("lo"), F.col("hi"))
    while not ranges.where(F.col("values") > buckets).isEmpty():
        wide = mine.join(ranges.where(F.col("values") > buckets), "_key").where(inside)
        part = F.least(F.floor((F.col("_value") - F.col("lo")) / (F.col("hi") / buckets - F.col("lo") / buckets)), F.lit(buckets - 1))
        parts = wide.withColumn("part", part).groupBy("_key", "part", "below", "first", "last").agg(F.sum("n").alias("n"), F.min("_value").alias("lo"), F.max("_value").alias("hi"), F.count("*").alias("values"))
        parts = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(along), F.lit(0)))
        parts = parts.where((F.col("below") <= F.col("last")) & (F.col("below") + F.col("n") > F.col("first")))
        # The middle ranks are neighbours, so these are one part, or two with nothing between them.
        refined = parts.groupBy("_key", "first", "last").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("below").alias("below"), F.sum("values").alias("values"))
        old, ranges = ranges, written(ranges.where(F.col("values") <= buckets).unionByName(refined), "ranges")
        discard(old)
    ranked = mine.join(ranges, "_key").where(inside)
    ranked = ranked.withColumn("from", F.col("below") + F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    value = F.when(F.col("_value") == largest, F.lit(float("inf"))).otherwise(F.col("_value"))
    at = lambda rank: F.max(F.when((F.col("from") <= F.col(rank)) & (F.col("from") + F.col("n") > F.col(rank)), value))
    out = written(ranked.groupBy("_key").agg((0.5 * at("first") + 0.5 * at("last")).alias("median")), "medians")
    discard(mine, ranges)
    return out.withColumnRenamed("_key", key)


def with_context(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """invoices with _vendor_exists, _copies and _is_outlier: what makes cross-row rules row rules.  Each is a
    grouped aggregate joined back, never a window over one key."""
    known = vendors.select(F.col("record_key").alias("vendor_record_key")).where("vendor_record_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    copies = invoices.groupBy("record_key").agg(F.count("*").alias("_copies")).where("_copies > 1")
    limits = outliers(invoices).select("vendor_record_key", F.col("limit").alias("_limit"))
    out = invoices.join(known, "vendor_record_key", "left").join(limits, "vendor_record_key", "left").join(copies, "record_key", "left")
    return out.select(
        *invoices.columns,
        F.coalesce("_known", F.lit(False)).alias("_vendor_exists"),
        F.coalesce("_copies", F.lit(1).cast("long")).alias("_copies"),
        F.coalesce(F.col("amount") > F.col("_limit"), F.lit(False)).alias("_is_outlier"),
    )


def failed_ids(rules: list[Rule], as_of: date) -> Column:
    """array of the ids of the rules a record fails, in the order of the ids."""
    if not rules:
        return F.expr("cast(array() as array<string>)")
    return F.filter(F.array(*[F.when(fails(r, as_of), F.lit(r.id)) for r in sorted(rules, key=lambda r: r.id)]), lambda x: x.isNotNull())


def of_entity(rules: list[Rule], entity: str) -> list[Rule]:
    return [r for r in rules if r.entity == entity]


def failures(vendors: DataFrame, context: DataFrame, rules: list[Rule], as_of: date) -> DataFrame:
    """(rule_id, entity, record_key, mode), one row for a rule and failing key."""
    parts = []
    for entity, df in (("vendor", vendors), ("invoice", context)):
        found = df.select("record_key", F.explode(failed_ids(of_entity(rules, entity), as_of)).alias("rule_id")).distinct()
        parts.append(found.select("rule_id", F.lit(entity).alias("entity"), "record_key"))
    modes = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.mode)])
    return parts[0].unionByName(parts[1]).withColumn("mode", modes[F.col("rule_id")])


def scorecard(vendors: DataFrame, context: DataFrame, rules: list[Rule], as_of: date) -> DataFrame:
    """A row for each rule: evaluated and failed rows, pass rate.  One aggregate for each entity."""
    parts = []
    for entity, df in (("vendor", vendors), ("invoice", context)):
        own = of_entity(rules, entity)
        if own:
            sums = df.agg(F.count("*").alias("evaluated"), *[F.coalesce(F.sum(fails(r, as_of).cast("long")), F.lit(0)).alias(r.id) for r in own])
            rows = [F.struct(*[F.lit(v).alias(n) for n, v in (("rule_id", r.id), ("name", r.name), ("entity", entity), ("dimension", r.dimension), ("severity", r.severity), ("mode", r.mode))], F.col(r.id).alias("failed")) for r in own]
            parts.append(sums.select("evaluated", F.explode(F.array(*rows)).alias("x")).select("x.*", "evaluated"))
    out = reduce(DataFrame.unionByName, parts)
    rate = F.when(F.col("evaluated") == 0, 1.0).otherwise(F.round(1 - F.col("failed") / F.col("evaluated"), 4))
    return out.select("rule_id", "name", "entity", "dimension", "severity", "evaluated", "failed", rate.alias("pass_rate"), "mode")


def valid_invoices(context: DataFrame, rules: list[Rule], as_of: date, columns: list[str]) -> DataFrame:
    return context.where(F.size(failed_ids(rules, as_of)) == 0).select(columns)


def quarantine(context: DataFrame, rules: list[Rule], as_of: date, columns: list[str]) -> DataFrame:
    """Failing rows; a failing key takes all its rows along.  failed_rules: ids of the key, comma-joined."""
    marked = context.withColumn("_failed", failed_ids(rules, as_of))
    bad = marked.where(F.size("_failed") > 0)
    by_key = bad.select("record_key", F.explode("_failed").alias("id")).groupBy("record_key").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("failed_rules"))
    return context.join(by_key, "record_key").select(*columns, "failed_rules")


def vendor_checks(vendors: DataFrame, rules: list[Rule], as_of: date) -> DataFrame:
    """A pass column for each vendor rule, and all of them; nothing is dropped."""
    own = of_entity(rules, "vendor")
    passed = [(~fails(r, as_of)).alias(f"pass_{r.id}") for r in own]
    return vendors.select("record_key", "source_system", *passed, (F.size(failed_ids(own, as_of)) == 0).alias("passes_all"))


def source_scores(vendors: DataFrame, context: DataFrame, rules: list[Rule], as_of: date) -> DataFrame:
    """records, passed, score by source and entity."""
    parts = [
        df.select(F.lit(entity).alias("entity"), "source_system", (F.size(failed_ids(of_entity(rules, entity), as_of)) == 0).cast("long").alias("ok"))
        for entity, df in (("vendor", vendors), ("invoice", context))
    ]
    return parts[0].unionByName(parts[1]).groupBy("source_system", "entity").agg(F.count("*").alias("records"), F.sum("ok").alias("passed"), F.round(F.avg("ok"), 4).alias("score"))


def preview(rule: Rule, df: DataFrame, as_of: date, limit: float = config.BLAST_RADIUS) -> DataFrame:
    """One row: evaluated, failed, fail_rate, blocked (too many fail), and failing keys by source as JSON."""
    bad = fails(rule, as_of)
    by_source = df.where(bad).groupBy(source_of(F.col("record_key")).alias("source")).agg(F.count_distinct("record_key").alias("n"))
    head = df.agg(F.count("*").alias("evaluated"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("failed"))
    by = by_source.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))).alias("by_source"))
    rate = F.when(F.col("evaluated") > 0, F.round(F.col("failed") / F.col("evaluated"), 4)).otherwise(0.0)
    return head.join(F.broadcast(by)).select("evaluated", "failed", rate.alias("fail_rate"), (rate > limit).alias("blocked"), "by_source")


def heuristic_rule(sentence: str, columns: dict[str, list[str]]) -> dict | None:
    """A rule from a plain sentence: the longest column name in it, the entity by keyword, the type by words."""
    low = sentence.lower().replace("_", " ")
    entity = "vendor" if "vendor" in low or "supplier" in low else "invoice" if "invoice" in low or "amount" in low else None
    named = sorted(((e, c) for e, cs in columns.items() for c in cs if c.replace("_", " ") in low and entity in (None, e)), key=lambda x: (-len(x[1]), x))
    if not named:
        return None
    entity, column = named[0]
    rule: dict = {"entity": entity, "column": column, "name": sentence.strip()}
    numbers = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*(?:\.\d+)?", low)]
    if "unique" in low or "duplicate" in low:
        return rule | {"type": "unique"}
    if (m := re.search(r"between (-?[\d.,]+) and (-?[\d.,]+)", low)) and len(numbers) >= 2:
        return rule | {"type": "range", "low": float(m[1].replace(",", "")), "high": float(m[2].replace(",", ""))}
    if numbers and re.search(r"at most|below|less than|under|not exceed|maximum|<=", low):
        return rule | {"type": "range", "high": numbers[-1]}
    if numbers and re.search(r"at least|above|more than|over|minimum|>=", low):
        return rule | {"type": "range", "low": numbers[-1]}
    if "future" in low:
        return rule | {"type": "date_not_future"}
    if "positive" in low:
        return rule | {"type": "positive"}
    if m := re.search(r"one of:? (.+)$", sentence, re.IGNORECASE):
        return rule | {"type": "allowed_values", "values": tuple(v.strip(" .") for v in re.split(r",| or ", m[1]) if v.strip(" ."))}
    if re.search(r"present|empty|missing|blank|required|null", low):
        return rule | {"type": "not_null"}
    return None


def views(schema: str, rules: list[Rule], as_of: str = "current_date()") -> dict[str, str]:
    """Dependency-ordered view statements with the rules as named conditions, over tables of a schema: silver_vendor,
    silver_invoice, and for certified spend gold_vendor_xref and ref_fx_rate (currency, usd_rate)."""
    context = f"""SELECT i.*, v.record_key IS NOT NULL AS _vendor_exists, c.n AS _copies, coalesce(i.amount > m.lim, FALSE) AS _is_outlier
FROM {schema}.silver_invoice i
LEFT JOIN (SELECT DISTINCT record_key FROM {schema}.silver_vendor) v ON v.record_key = i.vendor_record_key
LEFT JOIN (SELECT record_key, count(*) AS n FROM {schema}.silver_invoice GROUP BY record_key) c ON c.record_key = i.record_key
LEFT JOIN (SELECT vendor_record_key, {config.ANOMALY_MULTIPLIER} * percentile(amount, 0.5) AS lim FROM {schema}.silver_invoice WHERE amount > 0
           GROUP BY vendor_record_key HAVING count(*) >= {config.ANOMALY_MIN_HISTORY}) m ON m.vendor_record_key = i.vendor_record_key"""
    on_invoice = [*of_entity(rules, "invoice"), ANOMALY]
    good = [f"coalesce({check_sql(r, as_of)}, FALSE)" for r in on_invoice]
    marks = ", ".join(f"CASE WHEN NOT {g} THEN '{r.id}' END" for r, g in zip(on_invoice, good, strict=True))
    vendor = ", ".join(f"coalesce({check_sql(r, as_of)}, FALSE) AS {constraint_name(r.id, r.name)}" for r in of_entity(rules, "vendor"))
    every = " AND ".join(f"coalesce({check_sql(r, as_of)}, FALSE)" for r in of_entity(rules, "vendor")) or "TRUE"
    make = lambda name, body: f"CREATE OR REPLACE VIEW {schema}.{name} AS {body}"
    scores = f"""SELECT source_system, count(*) AS records, round(avg(passed), 4) AS dq_score, count_if(entity = 'invoice' AND passed = 0) AS quarantined_invoices, current_timestamp() AS scored_at
FROM (SELECT source_system, 'vendor' AS entity, CAST(passes_all AS INT) AS passed FROM {schema}.silver_vendor_dq
      UNION ALL SELECT i.source_system, 'invoice', CAST(q.record_key IS NULL AS INT) FROM {schema}.silver_invoice i
      LEFT JOIN (SELECT DISTINCT record_key FROM {schema}.silver_invoice_quarantine) q ON i.record_key = q.record_key) GROUP BY source_system"""
    certified = f"""SELECT v.record_key, x.master_key, v.source_system, v.invoice_no, v.invoice_date, v.currency, v.amount, round(v.amount * fx.usd_rate, 2) AS amount_usd
FROM {schema}.silver_invoice_valid v JOIN {schema}.gold_vendor_xref x ON v.vendor_record_key = x.record_key
JOIN {schema}.ref_fx_rate fx ON v.currency = fx.currency WHERE x.master_key IS NOT NULL AND v.amount * fx.usd_rate IS NOT NULL"""
    return {
        "silver_invoice_context": make("silver_invoice_context", context),
        "silver_invoice_valid": make("silver_invoice_valid", f"SELECT * FROM {schema}.silver_invoice_context WHERE " + " AND ".join(good)),
        "silver_invoice_quarantine": make("silver_invoice_quarantine", f"SELECT * FROM (SELECT *, filter(array({marks}), x -> x IS NOT NULL) AS failed_rules FROM {schema}.silver_invoice_context) WHERE size(failed_rules) > 0"),
        "silver_vendor_dq": make("silver_vendor_dq", f"SELECT record_key, source_system, {vendor}, {every} AS passes_all FROM {schema}.silver_vendor"),
        "gold_dq_source_score": make("gold_dq_source_score", scores),
        "gold_spend_certified": make("gold_spend_certified", certified),
    }
