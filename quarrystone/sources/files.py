"""Catalogue files, decisions as CSV, and what a run writes out for others: a CSV folder for each table, JSON reports."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import fields
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quarrystone.operators import library
from quarrystone.operators.rules import Rule
from quarrystone.operators.sentinel import AlertRule
from quarrystone.sources.store import Store, read_csv, write_csv

#: Tables of each layer that are exported.
LAYERS = {
    "bronze": ("bronze_vendors", "bronze_invoices"),
    "silver": ("silver_vendor", "silver_invoice", "silver_dq_failures", "silver_match_pairs"),
    "gold": ("gold_vendor", "gold_vendor_xref", "gold_spend_fact", "quarantine_invoice", "review_queue"),
    "reports": ("dq_scorecard", "dq_profile", "steward_patterns"),
}


def catalogue(spark: SparkSession, path: str) -> list[dict]:
    """The entries of a YAML or JSON file with a list under `rules`, from any file system that Spark reaches."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one file that people write
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict) or not isinstance(found.get("rules"), list):
        raise ValueError(f"{path} has no list of rules")
    return found["rules"]


def _made(kind: type, entries: Iterable[dict], names: dict[str, str]) -> tuple:
    """Entries as objects of a kind; keys that it doesn't have are left out, and it says what is missing."""
    out, known = [], {f.name for f in fields(kind)}
    for entry in entries:
        own = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in entry.items() if names.get(k, k) in known}
        try:
            out.append(kind(**own))
        except TypeError as e:
            raise ValueError(f"rule {entry.get('id')}: {e}") from None
    ids = [r.id for r in out]
    if len(set(ids)) < len(ids):
        raise ValueError("two rules have one id")
    return tuple(out)


def rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    return _made(Rule, catalogue(spark, path), {"min": "low", "max": "high", "allowed": "values"})


def alert_rules(spark: SparkSession, path: str) -> tuple[AlertRule, ...]:
    out = _made(AlertRule, catalogue(spark, path), {})
    if bad := [r.id for r in out if r.condition not in ("below", "above", "drop_vs_previous", "rise_vs_previous")]:
        raise ValueError(f"unknown condition in {', '.join(bad)}")
    return out


def decisions(store: Store, path: str) -> DataFrame:
    """Stewards' decisions from a CSV file (left_key, right_key, decision, reviewer, decided_at, perhaps note), in the
    form of the table; a missing file gives an empty one."""
    if not store.there(path):
        return store.spark.createDataFrame([], library.DECISIONS)
    raw = read_csv(store.spark, path)
    of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    a, b = F.least("left_key", "right_key"), F.greatest("left_key", "right_key")
    return raw.select(a.alias("left_key"), b.alias("right_key"), "decision", of("reviewer").alias("reviewer"), of("note").alias("note"), of("decided_at").try_cast("timestamp").alias("decided_at"))


def export(store: Store, folder: str) -> list[str]:
    """Every table of a layer that is there as a CSV folder, layer/table.csv; nested columns become JSON.  Gives the
    paths."""
    out = []
    for layer, names in LAYERS.items():
        for name in names:
            if store.exists(name):
                df = store.read(name)
                flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f.name) for f in df.schema]
                out.append(f"{folder.rstrip('/')}/{layer}/{name}.csv")
                write_csv(df.select(flat), out[-1])
    return out


def json_safe(value):
    """value with text keys, lists for tuples, null for what is no number, ISO text for dates and times."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, str):  # a number of numpy
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, date) or hasattr(value, "isoformat"):
        return value.isoformat()
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def report(store: Store, path: str, content: dict | list) -> None:
    """A JSON file, whole or not at all."""
    store.put(path, json.dumps(json_safe(content), indent=2, sort_keys=True))
