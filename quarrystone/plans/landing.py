"""Synthetic extracts into the landing zone, with their truth; a bad batch that can be taken out again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.config import SOURCES
from quarrystone.operators import standardize
from quarrystone.plans.engine import Engine
from quarrystone.sources import synth
from quarrystone.sources.store import Store, write_csv

BAD_BATCH = "invoices_bad_batch"
#: A seeded defect, and a vendor record with its true vendor.
DEFECT_KEYS, TRUTH_KEYS = ["entity", "record_key", "defect_type"], ["record_key"]


def _land(engine: Engine, rows: DataFrame, entity: str, name: str) -> None:
    """Canonical rows as the sources' own columns, a CSV folder for each source, as parallel as the rows."""
    for source in SOURCES:
        own = standardize.source_schema(source, entity)
        write_csv(rows.where(F.col("source") == source).select(*[F.col(k).alias(c) for k, c in own.items()]), f"{engine.root}/landing/{source}/{name}.csv")


def generate(engine: Engine, vendors: int = 3000, invoices: int = 45000, seed: int = 42) -> dict[str, int]:
    """Extracts of all sources in the landing zone, the true vendors and the seeded defects as tables."""
    v, of_vendors = synth.vendors(engine.spark, vendors, seed)
    i, of_invoices = synth.invoices(engine.spark, v, invoices, seed)
    _land(engine, v, "vendors", "vendors")
    _land(engine, i, "invoices", "invoices")
    defects = of_vendors.unionByName(of_invoices).distinct()
    with engine.store.commit():
        engine.store.merge("vendor_truth", TRUTH_KEYS, v.select("record_key", "true_vendor"))
        engine.store.merge("seeded_defects", DEFECT_KEYS, defects)
    counts = engine.store.read("seeded_defects").groupBy("entity").agg(F.count_distinct("record_key").alias("n")).collect()
    return {"true_vendors": vendors, "vendor_records": v.count(), "invoice_records": i.count(), **{f"{r['entity']}_records_with_defect": r["n"] for r in counts}}


def reset(engine: Engine, vendors: int = 3000, invoices: int = 45000, seed: int = 42) -> dict[str, int]:
    """Drop the landing zone and all tables, and generate anew."""
    engine.store.drop(f"{engine.root}/landing")
    engine.store.drop_all()
    engine.store = Store(engine.spark, engine.store.root)
    return generate(engine, vendors, invoices, seed)


def inject_bad_batch(engine: Engine, rows: int = 800, seed: int = 99) -> int:
    """Land invoices that are each wrong in one way, of the vendors that are there, and add their defects to the truth.
    A bad batch that is there already is replaced."""
    remove_bad_batch(engine)
    vendors = None
    for source in SOURCES:
        own = standardize.canonical(engine.landing(source, "vendors"), source, "vendors").select("source", "source_vendor_id", "record_key", "country_raw")
        vendors = own if vendors is None else vendors.unionByName(own)
    bad, defects = synth.bad_batch(engine.spark, vendors, rows, seed)
    _land(engine, bad, "invoices", BAD_BATCH)
    engine.store.merge("seeded_defects", DEFECT_KEYS, defects)
    return bad.count()


def remove_bad_batch(engine: Engine) -> bool:
    """Take the bad batch out of the landing zone and its defects out of the truth; whether there was one."""
    found = [engine.store.drop(f"{engine.root}/landing/{source}/{BAD_BATCH}.csv") for source in SOURCES]
    if engine.store.exists("seeded_defects"):
        mine = engine.store.read("seeded_defects").where(F.split_part("record_key", F.lit(":"), F.lit(-1)).startswith(synth.BAD_PREFIX))
        engine.store.merge("seeded_defects", DEFECT_KEYS, mine.limit(0), mine)
    return any(found)
