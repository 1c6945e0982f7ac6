"""Value mappings by joins, where there are too many for an expression.

Distinct values meet the table of mappings in an equi-join, which Spark turns into a broadcast only below its own limit
of bytes, and what comes of it is joined back to the rows; names are taken apart into tokens before and put together
after, once for each distinct name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.config import Mappings
from quarrystone.functions import text


def of_domain(mappings: Mappings, domain: str) -> DataFrame:
    return mappings.table.where(F.col("domain") == domain).select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))


def with_names(rows: DataFrame, mappings: Mappings, name: str = "vendor_name", out: str = "_norm") -> DataFrame:
    """rows with the normalised name, as `text.normalised_name` gives it for few mappings."""
    if mappings.table is None:
        return rows.withColumn(out, text.normalised_name(F.col(name), mappings.token))
    names = rows.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    tokens = names.select("_name", F.posexplode(text.name_tokens(F.col("_name"))).alias("_at", "_raw")).join(of_domain(mappings, "token"), "_raw", "left")
    word = F.coalesce("_canonical", text.mapped(mappings.token, F.col("_raw")), "_raw")
    # As many words as a name has.
    words = tokens.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_at", word.alias("word")))).alias("_words"))
    kept = F.filter(F.transform("_words", lambda w: w["word"]), lambda w: w != config.LEGAL_MARK)
    done = words.select("_name", F.nullif(F.array_join(kept, " "), F.lit("")).alias(out))
    return rows.join(done, rows[name] == done["_name"], "left").drop("_name")


def with_value(rows: DataFrame, mappings: Mappings, domain: str, column: str, out: str) -> DataFrame:
    """rows with what the table maps a column's trimmed capital value to; null if nothing does."""
    if mappings.table is None:
        return rows.withColumn(out, F.lit(None).cast("string"))
    return rows.withColumn("_raw", F.upper(text.blank_to_null(F.col(column)))).join(of_domain(mappings, domain).withColumnRenamed("_canonical", out), "_raw", "left").drop("_raw")


def without_known(values: DataFrame, column: str, domain: str, mappings: Mappings) -> DataFrame:
    """The rows whose value (trimmed, in capitals) nothing maps."""
    known = sorted(mappings.known(domain))
    out = values.where(~F.col(column).isin(known)) if known else values
    return out if mappings.table is None else out.join(of_domain(mappings, domain).select(F.col("_raw").alias(column)), column, "left_anti")
