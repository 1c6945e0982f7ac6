"""Running totals along an order of rows, however many of them share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.base import written


def in_blocks(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by range, with _block and _seq: a total order of rows in which blocks follow each other.  Written."""
    ordered = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    return written(ordered.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_seq", 33)), "blocks")


def running(blocks: DataFrame, key: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """blocks with running totals over each key's rows up to this one: name -> (sum or xor, column).  A window never
    holds more than a block; what a key has in earlier blocks comes from one row for each block that it begins in
    the middle of a key, at most as many rows as blocks."""
    whole = {"sum": F.sum, "xor": F.bit_xor}
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    parts = blocks.groupBy(key, "_block").agg(*(whole[how](c).alias(name) for name, (how, c) in sums.items()))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(key, "_block", *(whole[how](name).over(before).alias(f"_{name}") for name, (how, _) in sums.items()))
    carried = carried.where(F.col(f"_{next(iter(sums))}").isNotNull())
    here = Window.partitionBy(key, "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.select("*", *(whole[how](c).over(here).alias(name) for name, (how, c) in sums.items()))
    out = inside.join(F.broadcast(carried), [key, "_block"], "left")
    return out.select(*blocks.columns, *(add[how](F.col(name), F.coalesce(f"_{name}", F.lit(0))).alias(name) for name, (how, _) in sums.items()))
