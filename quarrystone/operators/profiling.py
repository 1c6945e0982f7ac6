"""Profiles of columns, token vocabularies and learned mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import config
from quarrystone.config import Mappings
from quarrystone.operators.mapped import without_known
from quarrystone.functions import text
from quarrystone.operators.matching import fuzzy_best


def profile(df: DataFrame, table: str, columns: list[str] | None = None, top: int = 3) -> DataFrame:
    """table, column, rows, null_rate, distinct (null is a value), top_patterns: the commonest shapes with their
    shares.  One scan: cells are counted by column and value before anything is shuffled."""
    columns = columns or df.columns
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    base = values.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("*").alias("distinct"))
    shapes = values.where("value IS NOT NULL").groupBy("column", text.shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"))
    ranked = shapes.withColumn("_at", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "shape"))).where(F.col("_at") <= top)
    ranked = ranked.join(base.select("column", "rows"), "column")
    named = F.concat("shape", F.lit("="), F.round(F.col("n") / F.col("rows"), 2).cast("string"))
    best = ranked.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", named.alias("v")))), lambda x: x["v"]), "; ").alias("top_patterns"))
    return base.join(best, "column", "left").select(F.lit(table).alias("table"), "column", "rows", F.round(F.col("nulls") / F.col("rows"), 4).alias("null_rate"), "distinct", F.coalesce("top_patterns", F.lit("")).alias("top_patterns"))


def token_counts(names: DataFrame, column: str) -> DataFrame:
    """(token, names): in how many names each token is."""
    return names.select(F.explode(F.array_distinct(text.name_tokens(F.col(column)))).alias("token")).groupBy("token").agg(F.count("*").alias("names"))


def vocabulary(names: DataFrame, column: str, mappings: Mappings | None = None) -> DataFrame:
    """(token, names, kind): core tokens are in max(3, min(20, N // 300)) names or more, the other ones rare unless
    they are digits or mapped."""
    total = names.agg(F.count("*").alias("N"))
    least = F.greatest(F.lit(3), F.least(F.lit(20), F.floor(F.col("N") / 300)))
    df = token_counts(names, column).join(F.broadcast(total))  # one row
    df = df.withColumn("kind", F.when(F.col("names") >= least, "core").when(~F.col("token").rlike("^[0-9]+$"), "rare")).select("token", "names", "kind")
    core, rare = (df.where(F.col("kind") == kind) for kind in ("core", "rare"))
    return core.unionByName(rare if mappings is None else without_known(rare, "token", "token", mappings).select(df.columns))


def valid_canonical(domain: str, raw: Column, canonical: Column, core: Column | None = None) -> Column:
    """Whether a proposed canonical value may be used: it is known, and a correction keeps the first letter."""
    if domain == "city":
        return canonical.isin(sorted(config.CITIES))
    if domain == "currency":
        return canonical.isin(*config.VALID_CURRENCIES)
    ok = (canonical == config.LEGAL_MARK) | (F.substring(canonical, 1, 1) == F.substring(raw, 1, 1))
    return ok if core is None else ok & ((canonical == config.LEGAL_MARK) | core)


def learn_tokens(names: DataFrame, column: str, mappings: Mappings) -> DataFrame:
    """(raw, canonical, similarity, affected): rare name tokens that are a spelling of a core token."""
    vocab = vocabulary(names, column, mappings)
    rare = vocab.where("kind = 'rare'").select(F.col("token").alias("value"), "names")
    best = fuzzy_best(rare.select("value"), vocab.where("kind = 'core'").select(F.col("token").alias("word")))
    return best.join(rare, "value").select(F.col("value").alias("raw"), F.col("best").alias("canonical"), "similarity", F.col("names").alias("affected"))


def unmapped(values: DataFrame, column: str, mappings: Mappings, domain: str, decided: list[str] = ()) -> DataFrame:
    """(value, affected): values of a domain that nothing maps yet."""
    bare = text.blank_to_null(F.col(column))
    out = without_known(values.select(bare.alias("value"), F.upper(bare).alias("_value")).where("value IS NOT NULL"), "_value", domain, mappings)
    out = out.where(~F.col("_value").isin(sorted(decided))) if decided else out
    return out.groupBy("value").agg(F.count("*").alias("affected"))
