"""Synthetic extracts with seeded defects and their truth, from row numbers alone: no state, any size, any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import CITIES, COUNTRIES, SOURCES
from quarrystone.sources.extract import INDUSTRIES, PLACES, STEMS

# Shares of rows with a defect.
VENDOR_RATES = {"tax_missing": 0.10, "tax_invalid": 0.06, "country_invalid": 0.05, "email_invalid": 0.08, "name_typo": 0.08}
INVOICE_RATES = {"amount_negative": 0.04, "amount_missing": 0.03, "amount_outlier": 0.03, "date_future": 0.04, "date_invalid": 0.03, "currency_bad": 0.05, "orphan": 0.05}
EXPECTED = {
    "tax_missing": "R01", "tax_invalid": "R02", "country_invalid": "R03", "email_invalid": "R04", "amount_negative": "R05", "amount_missing": "R05",
    "amount_outlier": "A01", "date_future": "R06", "date_invalid": "R06", "currency_bad": "R07", "orphan": "R08",
}

#: Numbers of a bad batch begin with it.
BAD_PREFIX = "BAD"


def _draw(seed: int, salt: str, *keys: str) -> Column:
    """A number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) / float(1 << 30)


def _one_of(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw * len(values)) + 1).cast("int"))


def _defect(rates: dict[str, float], groups: list[tuple[str, ...]], seed: int, *keys: str) -> Column:
    """array of the defects of a row; those of one group exclude each other."""
    out = []
    for g in groups:
        draw, at, case = _draw(seed, g[0], *keys), 0.0, F.lit(None).cast("string")
        chain = None
        for d in g:
            here = (draw >= at) & (draw < at + rates[d])
            chain = F.when(here, d) if chain is None else chain.when(here, d)
            at += rates[d]
        out.append(chain if chain is not None else case)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def vendors(spark: SparkSession, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Canonical vendor rows of n companies, in one to three sources each, and defects (entity, record_key,
    defect_type, expected_rule).  true_vendor is a column of the rows."""
    df = spark.range(n).withColumn("places", F.when(_draw(seed, "places", "id") < 0.45, 1).when(_draw(seed, "places", "id") < 0.80, 2).otherwise(3))
    df = df.withColumn("shift", F.floor(_draw(seed, "shift", "id") * 3).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    df = df.withColumn("source", F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("shift") + F.col("copy")) % 3 + 1))
    df = df.withColumn("defects", _defect(VENDOR_RATES, [("tax_missing", "tax_invalid"), ("country_invalid",), ("email_invalid",), ("name_typo",)], seed, "id", "copy"))
    has = lambda d: F.array_contains("defects", d)
    iso = _one_of(list(COUNTRIES), _draw(seed, "country", "id"))
    name = F.concat_ws(" ", _one_of(STEMS, _draw(seed, "stem", "id")), _one_of(PLACES, _draw(seed, "place", "id")), _one_of(INDUSTRIES, _draw(seed, "trade", "id")))
    name = F.concat(name, F.lit(" "), (F.col("id") % 97).cast("string"))
    named = F.when(has("name_typo"), F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))).otherwise(name)
    tax = F.concat(iso, F.upper(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 10)))
    key = F.concat(F.lit("V"), F.lpad(F.col("id").cast("string"), 9, "0"))
    rows = df.select(
        "source", key.alias("source_vendor_id"), F.concat("source", F.lit(":"), key).alias("record_key"), F.col("id").alias("true_vendor"),
        F.concat(named, F.when(F.col("copy") % 2 == 0, " Pvt. Ltd.").otherwise(" LIMITED")).alias("vendor_name"), F.concat((F.col("id") % 900 + 100).cast("string"), F.lit(" Main Street")).alias("street"),
        F.when(has("tax_missing"), "").when(has("tax_invalid"), F.substring(tax, 1, 7)).otherwise(tax).alias("tax_id_raw"), F.when(has("country_invalid"), "ZZZ").otherwise(iso).alias("country_raw"),
        _one_of(list(CITIES), _draw(seed, "city", "id")).alias("city_raw"), F.concat(F.lit("0091"), (F.lit(9_000_000_000) + F.col("id") * 7919).cast("string")).alias("phone_raw"),
        F.concat(F.lit("ap"), F.when(has("email_invalid"), " at ").otherwise("@"), F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit(".com")).alias("email_raw"),
        (F.lit(100_000_000_000) + F.col("id") * 104729).cast("string").alias("bank_raw"), "defects",
    )
    return rows.drop("defects"), _truth(rows, "vendor")


def invoices(spark: SparkSession, vendor_rows: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Canonical invoice rows of vendors drawn by number, and their defects."""
    known = vendor_rows.select("source", "source_vendor_id", "country_raw", F.pmod(F.xxhash64("record_key"), F.lit(1 << 20)).alias("slot"))
    total = max(1, known.count())
    from quarrystone.operators.golden import numbered_rows

    known = numbered_rows(known, [F.col("slot"), F.col("source"), F.col("source_vendor_id")]).select("source", "source_vendor_id", (F.col("_no") - 1).alias("no"))
    df = spark.range(n).withColumn("no", F.floor(_draw(seed, "vendor", "id") * total).cast("long")).join(known, "no")
    df = df.withColumn("defects", _defect(INVOICE_RATES, [("amount_negative", "amount_missing", "amount_outlier"), ("date_future", "date_invalid"), ("currency_bad",), ("orphan",)], seed, "id"))
    has = lambda d: F.array_contains("defects", d)
    amount = F.round(100 + 900 * _draw(seed, "amount", "id") * F.when(has("amount_outlier"), 100.0).otherwise(1.0) + F.when(has("amount_outlier"), 60_000.0).otherwise(0.0), 2)
    shown = F.when(has("amount_missing"), "").when(has("amount_negative"), F.concat(F.lit("-"), amount.cast("string"))).otherwise(amount.cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(_draw(seed, "day", "id") * 700).cast("int"))
    day = F.when(has("date_future"), F.add_months(day, 60)).otherwise(day)
    pattern = F.when(F.col("source") == "ERP_A", F.date_format(day, "yyyyMMdd")).when(F.col("source") == "ERP_B", F.upper(F.date_format(day, "dd-MMM-yyyy"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    vendor = F.when(has("orphan"), F.concat(F.lit("X"), "source_vendor_id")).otherwise(F.col("source_vendor_id"))
    number = F.concat(F.lit("INV"), F.lpad(F.col("id").cast("string"), 9, "0"))
    rows = df.select(
        "source", number.alias("invoice_no"), F.concat("source", F.lit(":INV:"), number).alias("record_key"), vendor.alias("source_vendor_id"), F.concat("source", F.lit(":"), vendor).alias("vendor_record_key"),
        shown.alias("amount_raw"), F.when(has("date_invalid"), "not a date").otherwise(pattern).alias("invoice_date_raw"), F.when(has("currency_bad"), "XXX").otherwise("USD").alias("currency_raw"), "defects",
    )
    return rows.drop("defects"), _truth(rows, "invoice")


def _truth(rows: DataFrame, entity: str) -> DataFrame:
    rule = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    return rows.select(F.lit(entity).alias("entity"), "record_key", F.explode("defects").alias("defect_type")).withColumn("expected_rule", rule[F.col("defect_type")])


def bad_batch(spark: SparkSession, vendor_rows: DataFrame, n: int, seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """Extra invoices that each have one of four defects."""
    rows, _ = invoices(spark, vendor_rows, n, seed)
    kind = _one_of(["amount_missing", "date_invalid", "currency_bad", "orphan"], _draw(seed, "kind", "record_key"))
    rows = rows.withColumn("defects", F.array(kind)).withColumn("invoice_no", F.concat(F.lit(BAD_PREFIX), "invoice_no")).withColumn("record_key", F.concat("source", F.lit(":INV:"), "invoice_no"))
    is_ = lambda d: F.col("defects")[0] == d
    rows = rows.withColumns({
        "amount_raw": F.when(is_("amount_missing"), "").otherwise(F.col("amount_raw")),
        "invoice_date_raw": F.when(is_("date_invalid"), "not a date").otherwise(F.col("invoice_date_raw")),
        "currency_raw": F.when(is_("currency_bad"), "XXX").otherwise(F.col("currency_raw")),
        "source_vendor_id": F.when(is_("orphan"), F.concat(F.lit("X"), "source_vendor_id")).otherwise(F.col("source_vendor_id")),
        "vendor_record_key": F.when(is_("orphan"), F.concat("source", F.lit(":X"), "source_vendor_id")).otherwise(F.col("vendor_record_key")),
    })
    return rows.drop("defects"), _truth(rows, "invoice")
