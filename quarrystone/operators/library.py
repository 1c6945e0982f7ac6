"""The versioned library of rules, mappings, fixes and decisions: append only, the latest version of an item counts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import Mappings
from quarrystone.operators.matching import latest
from quarrystone.sources.scratch import written

#: Mappings that go into an expression, which looks through them for each value.
LITERAL_MAPPINGS = 500

SCHEMA = "library_version long, item_id string, kind string, definition string, status string, source string, confidence double, approved_by string, approved_at timestamp, affected_records long, note string, run_id string"
DECISIONS = "left_key string, right_key string, decision string, reviewer string, note string, decided_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def active(history: DataFrame, kind: str | None = None) -> DataFrame:
    """The last version of each item, unless it was retired."""
    out = latest(history, ["item_id"], ["library_version", "approved_at", "status"]).where("status = 'active'")
    out = out.select(history.columns)
    return out.where(F.col("kind") == kind) if kind else out


def version(history: DataFrame) -> int:
    return int(history.agg(F.coalesce(F.max("library_version"), F.lit(0).cast("long"))).first()[0])


def field(name: str) -> Column:
    return F.get_json_object("definition", f"$.{name}")


def approve(history: DataFrame, items: DataFrame, by: str, at, source: str = "steward", run_id: str = "", note: str = "", status: str = "active") -> DataFrame:
    """Rows to append for items (item_id, kind, definition, confidence, affected_records), as the next version.
    Whoever appends them must be the only writer meanwhile."""
    return items.select(
        F.lit(version(history) + 1).cast("long").alias("library_version"), "item_id", "kind", "definition", F.lit(status).alias("status"), F.lit(source).alias("source"),
        F.col("confidence").cast("double").alias("confidence"), F.lit(by).alias("approved_by"), F.lit(at).cast("timestamp").alias("approved_at"), F.col("affected_records").cast("long").alias("affected_records"), F.lit(note).alias("note"), F.lit(run_id).alias("run_id"),
    )


def retire(history: DataFrame, item_id: str, by: str, at, note: str = "") -> DataFrame:
    return approve(history, active(history).where(F.col("item_id") == item_id), by, at, note=note, status="retired")


def next_rule_id(history: DataFrame) -> str:
    """C and the number after the largest ever given, so that ids of retired rules aren't given again."""
    number = F.regexp_extract("item_id", "^C([0-9]+)$", 1)
    top = history.where("kind = 'dq_rule'").agg(F.max(F.when(number != "", number.cast("int")))).first()[0] or 0
    return f"C{top + 1:02d}"


def mappings(history: DataFrame, base: Mappings, literals: int = LITERAL_MAPPINGS) -> Mappings:
    """The base with the library's active mappings.  Up to so many go into expressions; more stay a table."""
    rows = active(history, "value_mapping").select("library_version", field("domain").alias("d"), field("raw_value").alias("r"), field("canonical").alias("c")).where("c IS NOT NULL AND d IN ('city', 'currency', 'token')")
    few = rows.limit(literals + 1).collect()
    if len(few) <= literals:
        return base.with_items([(x["d"], x["r"], x["c"]) for x in sorted(few, key=lambda x: (x["library_version"], x["r"]))])
    table = latest(rows, ["d", "r"], ["library_version", "c"]).select(F.col("d").alias("domain"), F.col("r").alias("raw"), F.col("c").alias("canonical"))
    return replace(base, table=written(table, "mappings"))


def match_rules(history: DataFrame) -> DataFrame:
    return active(history, "match_rule").select(field("signature").alias("signature"), "item_id", field("decision").alias("decision"))


def record_fixes(history: DataFrame) -> list[dict]:
    rows = active(history, "record_fix").select("library_version", "item_id", field("source_system").alias("s"), field("currency_raw").alias("r")).collect()
    return [{"id": x["item_id"], "source": x["s"], "raw": x["r"]} for x in sorted(rows, key=lambda x: (x["library_version"], x["item_id"]))]


def acknowledged(history: DataFrame) -> list[str]:
    return sorted(r["item_id"] for r in active(history, "acknowledge").select("item_id").collect())


def cannot_links(history: DataFrame) -> DataFrame:
    a, b = field("left_key"), field("right_key")
    return active(history, "cannot_link").select(F.least(a, b).alias("left_key"), F.greatest(a, b).alias("right_key"))


def cannot_link_items(xref: DataFrame, record_key: str) -> DataFrame:
    """Items that keep one record apart from every other member of its golden vendor."""
    mine = xref.where(F.col("record_key") == record_key).select("master_key")
    others = xref.where(F.col("record_key") != record_key).join(mine, "master_key", "left_semi").select("record_key")
    a, b = F.least("record_key", F.lit(record_key)), F.greatest("record_key", F.lit(record_key))
    definition = F.to_json(F.struct(a.alias("left_key"), b.alias("right_key")))
    return others.select(F.concat(F.lit("CANNOT:"), a, F.lit("|"), b).alias("item_id"), F.lit("cannot_link").alias("kind"), definition.alias("definition"), F.lit(1.0).alias("confidence"), F.lit(1).alias("affected_records"))


def explain(xref: DataFrame, edges: DataFrame, alerts: DataFrame, master_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, the merges that touch one of them, and alerts of a golden vendor."""
    members = xref.where(F.col("master_key") == master_key)
    keys = members.select("record_key")
    left = edges.join(keys.withColumnRenamed("record_key", "left_key"), "left_key", "left_semi").select(edges.columns)
    right = edges.join(keys.withColumnRenamed("record_key", "right_key"), "right_key", "left_semi").select(edges.columns)
    return members, left.unionByName(right).distinct(), alerts.where(F.col("master_key") == master_key)


def recommend(pair: DataFrame) -> DataFrame:
    """What to answer for pairs, by the rules."""
    return pair.withColumn("recommendation", F.when(F.col("tax_conflict"), "no_match").when(F.col("score") >= 0.8, "match").otherwise("unsure"))


def unseen(inbox: DataFrame, processed: DataFrame, name: str) -> DataFrame:
    """Inbox rows that no run has applied yet; processed: inbox, id."""
    return inbox.join(processed.where(F.col("inbox") == name).select("id").distinct(), "id", "left_anti")
