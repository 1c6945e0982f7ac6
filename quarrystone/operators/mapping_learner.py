"""Learning value mappings: for each value that nothing maps, a canonical value, how sure it is, and who says so.

An earlier answer of the assistant comes first, then a spelling close enough by rule; a name token may also get the
most similar core word, if it has the same first letter, for a steward to judge.  Proposals are validated; valid and
sure ones are approved by policy, the others go to stewards with a reason and the five most similar options.  Tokens meet
core words of any length by an exact search (`operators.nearest`), so abbreviations find what they stand for; cities,
currencies and legal forms are short literal lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.config import Mappings
from quarrystone.functions.similarity import token_sort_ratio
from quarrystone.operators.mapped import without_known
from quarrystone.operators.nearest import nearest_words
from quarrystone.operators.profiling import valid_canonical, vocabulary
from quarrystone.sources.scratch import written

ANSWERS = "domain string, raw string, canonical string, confidence double"
#: A legal form needs this similarity.
LEGAL_SIMILARITY = 0.75
OPTIONS = 5
#: Letters by which a close spelling may be longer or shorter.
FUZZY_LENGTH = 2


def unknown(values: DataFrame, column: str, domain: str, mappings: Mappings) -> DataFrame:
    """(domain, raw, affected): trimmed capital values of a column that have no mapping."""
    raw = F.upper(F.trim(F.col(column)))
    out = values.select(F.lit(domain).alias("domain"), raw.alias("raw")).where("raw <> ''")
    return without_known(out, "raw", domain, mappings).groupBy("domain", "raw").agg(F.count("*").alias("affected"))


def _literals(open_: DataFrame, domain: str, canonical: list[str]) -> DataFrame:
    """Every value of a domain with each of a short list of canonical values."""
    words = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(c.upper()).alias("word")) for c in canonical])
    return open_.where(F.col("domain") == domain).select("domain", "raw", F.explode(words).alias("x")).select("domain", "raw", "x.canonical", "x.word")


def learn(vendors: DataFrame, invoices: DataFrame, mappings: Mappings, answers: DataFrame | None = None) -> DataFrame:
    """vendors: vendor_name, city_raw; invoices: currency_raw; answers: domain, raw, canonical, confidence.  Gives
    domain, raw, canonical, confidence, affected, source (assistant, rule or none), options, reason, approved."""
    vocab = written(vocabulary(vendors, "vendor_name", mappings), "vocabulary")
    core = vocab.where("kind = 'core'")
    open_ = unknown(vendors, "city_raw", "city", mappings).unionByName(unknown(invoices, "currency_raw", "currency", mappings))
    open_ = open_.unionByName(vocab.where("kind = 'rare'").select(F.lit("token").alias("domain"), F.col("token").alias("raw"), F.col("names").alias("affected")))
    open_ = written(open_, "open")  # read by each of the joins below
    pairs = _literals(open_, "city", list(config.CITIES)).unionByName(_literals(open_, "currency", list(config.VALID_CURRENCIES)))
    legal = open_.where((F.col("domain") == "token") & (F.length("raw") > 2)).select("raw", F.explode(F.lit(list(config.LEGAL_TOKENS))).alias("canonical"))
    legal = legal.where(F.substring("raw", 1, 1) == F.substring("canonical", 1, 1)).groupBy("raw").agg(F.max(token_sort_ratio(F.col("raw"), F.col("canonical"))).alias("legal"))
    order = F.struct((-token_sort_ratio(F.col("raw"), F.col("word"))).alias("s"), "canonical")
    # The words of one value are bounded by the lists.
    literal = pairs.groupBy("domain", "raw").agg(F.array_sort(F.collect_list(order)).alias("all")).select("domain", "raw", F.transform(F.slice("all", 1, OPTIONS), lambda x: F.struct((-x["s"]).alias("s"), x["canonical"].alias("canonical"))).alias("top"))
    tokens = nearest_words(open_.where("domain = 'token'").select("raw"), core, OPTIONS)
    tokens = tokens.select(F.lit("token").alias("domain"), "raw", F.transform("top", lambda x: F.struct(x["similarity"].alias("s"), x["word"].alias("canonical"))).alias("top"))
    best = literal.unionByName(tokens).withColumn("best", F.get("top", F.lit(0)))
    same_first = F.substring("raw", 1, 1) == F.upper(F.substring("best.canonical", 1, 1))
    spelled = (F.col("domain") != "currency") & (F.col("best.s") >= config.FUZZY_APPROVE) & same_first & (F.abs(F.length("raw") - F.length("best.canonical")) <= FUZZY_LENGTH)
    best = best.withColumn("spelled", spelled).withColumn("same_first", same_first)
    told = (answers if answers is not None else open_.sparkSession.createDataFrame([], ANSWERS)).select("domain", "raw", F.col("canonical").alias("said"), F.col("confidence").alias("sure"))
    df = open_.join(best, ["domain", "raw"], "left").join(told, ["domain", "raw"], "left").join(legal, "raw", "left")
    guess = F.struct(F.lit(None).cast("string").alias("canonical"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"))
    pick = lambda canonical, confidence, source: F.struct(canonical.alias("canonical"), F.round(confidence, 3).alias("confidence"), F.lit(source).alias("source"))
    is_token = F.col("domain") == "token"
    chosen = (
        F.when(F.col("said").isNotNull(), pick(F.col("said"), F.col("sure"), "assistant"))
        .when(F.col("spelled"), pick(F.col("best.canonical"), F.col("best.s"), "rule"))
        .when(is_token & (F.col("legal") >= LEGAL_SIMILARITY), pick(F.lit(config.LEGAL_MARK), F.col("legal"), "rule"))
        .when(is_token & F.col("same_first"), pick(F.col("best.canonical"), F.col("best.s"), "rule"))
        .otherwise(guess)
    )
    df = df.select("domain", "raw", "affected", chosen.alias("x"), F.coalesce(F.transform("top", lambda t: t["canonical"]), F.expr("cast(array() as array<string>)")).alias("options"))
    df = df.select("domain", "raw", "affected", "x.*", "options").join(core.select(F.col("token").alias("canonical"), F.lit(True).alias("_core")), "canonical", "left")
    ok = F.lit(False)
    for domain in ("token", "currency", "city"):
        ok = F.when(F.col("domain") == domain, valid_canonical(domain, F.col("raw"), F.col("canonical"), F.coalesce("_core", F.lit(False)))).otherwise(ok)
    bad = F.col("canonical").isNotNull() & ~F.coalesce(ok, F.lit(False))
    approved = F.col("canonical").isNotNull() & ~bad & (F.col("confidence") >= config.AUTO_APPROVE)
    reason = F.when(bad, F.concat(F.lit("not an allowed "), F.col("domain"), F.lit(" for this value"))).otherwise(F.format_string("confidence %.2f", "confidence"))
    return df.select("domain", "raw", F.when(~bad, F.col("canonical")).alias("canonical"), "confidence", "affected", "source", "options", reason.alias("reason"), approved.alias("approved"))


def item_id() -> Column:
    return F.concat_ws(":", F.lit("MAP"), "domain", "raw")


def library_items(rows: DataFrame) -> DataFrame:
    """Library items of rows (domain, raw, canonical, confidence, affected)."""
    definition = F.to_json(F.struct("canonical", "domain", F.col("raw").alias("raw_value")))
    return rows.select(item_id().alias("item_id"), F.lit("value_mapping").alias("kind"), definition.alias("definition"), "confidence", F.col("affected").alias("affected_records"))
