"""Certified spend on golden vendors, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone import config


def usd(amount: Column, currency: Column) -> Column:
    rates = F.create_map(*[F.lit(x) for kv in config.FX_TO_USD.items() for x in kv])
    return F.round(amount * rates[currency], 2)


def fact(valid: DataFrame, xref: DataFrame) -> DataFrame:
    """Valid invoices of known vendors with the golden key and the amount in US dollars; rows without either go."""
    out = valid.join(xref.select(F.col("record_key").alias("vendor_record_key"), "master_key").dropDuplicates(["vendor_record_key"]), "vendor_record_key")
    out = out.withColumn("amount_usd", usd(F.col("amount"), F.col("currency"))).where("master_key IS NOT NULL AND amount_usd IS NOT NULL")
    return out.select("record_key", "master_key", "source_system", "invoice_no", "invoice_date", "currency", "amount", "amount_usd")


def by_month(spend: DataFrame) -> DataFrame:
    return spend.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(F.round(F.sum("amount_usd"), 2).alias("spend_usd"), F.count("*").alias("invoices"))


def top_vendors(spend: DataFrame, gold: DataFrame, n: int = 10) -> DataFrame:
    total = spend.groupBy("master_key").agg(F.round(F.sum("amount_usd"), 2).alias("spend_usd"))
    return total.join(gold.select("master_key", "vendor_name", "country_iso2"), "master_key").orderBy(F.desc("spend_usd"), "master_key").limit(n)


def kpis(spend: DataFrame, gold: DataFrame) -> DataFrame:
    a = spend.agg(F.round(F.sum("amount_usd"), 2).alias("total_spend_usd"), F.count_distinct("master_key").alias("vendors_with_spend"))
    b = gold.agg(F.count("*").alias("golden_vendors"), F.count_if(F.contains("source_systems", F.lit(","))).alias("multi_source_vendors"))
    return a.join(F.broadcast(b))  # one row each


def valid_spend_by_country(context: DataFrame, vendors: DataFrame, failed: Column) -> DataFrame:
    """Valid spend and quarantined invoices by the vendor's country: one pass over the invoices."""
    country = vendors.groupBy(F.col("record_key").alias("vendor_record_key")).agg(F.max("country_iso2").alias("country"))
    df = context.join(country, "vendor_record_key", "left").withColumn("_bad", F.size(failed) > 0)
    value = F.when(~F.col("_bad"), usd(F.col("amount"), F.col("currency")))
    return df.groupBy(F.coalesce("country", F.lit("??")).alias("country")).agg(
        F.count("*").alias("invoices"), F.count_if("_bad").alias("quarantined"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("valid_usd")
    )
