"""Duplicate vendors: blocks, pairs, scores, bands, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import config
from quarrystone.functions.similarity import token_sort_ratio


def valid_tax(c: Column) -> Column:
    return F.coalesce(c.rlike(config.TAX_ID_PATTERN), F.lit(False))


def block_keys(vendors: DataFrame) -> DataFrame:
    """(block, record_key): valid tax id, phone, and country with the name's first four characters."""
    phone = F.coalesce("phone_token", "phone")
    keys = F.array(
        F.when(valid_tax(F.col("tax_id")), F.concat(F.lit("tax|"), "tax_id")),
        F.concat(F.lit("phone|"), phone),
        F.concat(F.lit("name|"), F.coalesce("country_iso2", F.lit("??")), F.lit("|"), F.substring(F.coalesce("vendor_name_norm", F.lit("")), 1, 4)),
    )
    return vendors.select(F.explode(keys).alias("block"), "record_key").where("block IS NOT NULL")


def candidate_pairs(vendors: DataFrame, max_block: int = config.MAX_BLOCK) -> DataFrame:
    """(left_key, right_key), left before right, of records that share a block of 2 to max_block rows.  Larger
    blocks go before the self-join, by a count that is combined ahead of the shuffle, so none is ever gathered."""
    keys = block_keys(vendors)
    sizes = keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_block)).select("block")
    usable = keys.join(sizes, "block")
    left, right = usable.withColumnRenamed("record_key", "left_key"), usable.withColumnRenamed("record_key", "right_key")
    return left.join(right, "block").where("left_key < right_key").select("left_key", "right_key").distinct()


_FEATURES = ("vendor_name", "vendor_name_norm", "tax_id", "city", "phone", "phone_token", "email_domain")


def _equal(a: str, b: str) -> Column:
    return F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))


def score_pairs(vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity, agreement flags, score, band, explanation and signature of each pair; expressions only."""
    side = lambda s: vendors.dropDuplicates(["record_key"]).select(F.col("record_key").alias(f"{s}_key"), *[F.col(f).alias(f"{s}_{f}") for f in _FEATURES])
    df = pairs.join(side("left"), "left_key").join(side("right"), "right_key")
    both_tax = valid_tax(F.col("left_tax_id")) & valid_tax(F.col("right_tax_id"))
    phone = F.when(F.col("left_phone_token").isNotNull() & F.col("right_phone_token").isNotNull(), _equal("left_phone_token", "right_phone_token")).otherwise(_equal("left_phone", "right_phone"))
    df = df.withColumns({
        "sim": token_sort_ratio(F.col("left_vendor_name_norm"), F.col("right_vendor_name_norm")),
        "tax_eq": both_tax & (F.col("left_tax_id") == F.col("right_tax_id")),
        "tax_conflict": both_tax & (F.col("left_tax_id") != F.col("right_tax_id")),
        "city_eq": _equal("left_city", "right_city"),
        "phone_eq": phone,
        "domain_eq": _equal("left_email_domain", "right_email_domain"),
    })
    flag = lambda n: F.col(n).cast("int")
    score = (
        F.when(F.col("tax_eq"), 0.6 + 0.4 * F.col("sim"))
        .when(F.col("tax_conflict"), 0.4 * F.col("sim"))
        .otherwise(0.55 * F.col("sim") + 0.15 * flag("city_eq") + 0.15 * flag("phone_eq") + 0.15 * flag("domain_eq"))
    )
    df = df.withColumn("name_similarity", F.round("sim", 4)).withColumn("score", F.round(score, 4))
    df = df.withColumn("band", band(F.col("score"))).withColumn("signature", signature()).withColumn("explanation", explanation())
    names = ["left_key", "right_key", F.col("left_vendor_name").alias("left_name"), F.col("right_vendor_name").alias("right_name")]
    return df.select(*names, "name_similarity", "tax_eq", "tax_conflict", "city_eq", "phone_eq", "domain_eq", "score", "band", "signature", "explanation")


def band(score: Column) -> Column:
    return F.when(score >= config.HIGH_BAND, "HIGH").when(score >= config.MEDIUM_BAND, "MEDIUM").otherwise("LOW")


def signature() -> Column:
    yes = lambda n: F.when(F.col(n), "y").otherwise("n")
    tax = F.when(F.col("tax_eq"), "same").when(F.col("tax_conflict"), "conflict").otherwise("missing")
    tenth = F.concat(F.lit("0."), F.floor(F.col("name_similarity") * 10).cast("string"))
    name = F.when(F.col("name_similarity") >= 1, "1.0").otherwise(tenth)
    return F.concat(F.lit("tax:"), tax, F.lit("|name>="), name, F.lit("|city:"), yes("city_eq"), F.lit("|phone:"), yes("phone_eq"), F.lit("|domain:"), yes("domain_eq"))


def explanation() -> Column:
    parts = [
        F.when(F.col("tax_eq"), "same tax ID").when(F.col("tax_conflict"), "different valid tax IDs"),
        F.concat(F.lit("name similarity "), F.format_string("%.2f", "name_similarity")),
        F.when(F.col("city_eq"), "same city").otherwise("different or missing city"),
        F.when(F.col("phone_eq"), "same phone"),
        F.when(F.col("domain_eq"), "same email domain"),
    ]
    text = F.concat_ws("; ", *parts)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000))


def guarded_band(score: Column, tax_conflict: Column, decision: Column, confidence: Column) -> Column:
    """What an assistant's opinion may do to a band: it never joins over a tax conflict, and only lifts or lowers
    inside its bounds when it is sure."""
    sure = F.coalesce(confidence >= config.AI_MIN_CONFIDENCE, F.lit(False))
    return (
        F.when(decision.isNull(), band(score))
        .when((decision == "same") & sure & ~tax_conflict, F.when(score >= config.AI_PROMOTE_SCORE, "HIGH").otherwise("MEDIUM"))
        .when((decision == "different") & sure & (score < config.MEDIUM_BAND), "LOW")
        .when(tax_conflict, "LOW")
        .when((score >= config.MEDIUM_BAND) | (decision == "same"), "MEDIUM")
        .otherwise(band(score))
    )


def fingerprint(left: list[Column], right: list[Column]) -> Column:
    """sha1 of both records' descriptions, whichever comes first."""
    say = lambda cs: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cs])
    a, b = say(left), say(right)
    return F.sha1(F.concat_ws("||", F.least(a, b), F.greatest(a, b)).cast("binary"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a total order: combined before the shuffle, no window over a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def decide(scored: DataFrame, steward: DataFrame, match_rules: DataFrame, any_band: bool) -> DataFrame:
    """merge and decided_by of each pair.  steward: left_key, right_key, decision, reviewer, note, decided_at;
    match_rules: signature, item_id, decision.  Stewards come first, then rules (for the middle band), then bands."""
    told = latest(steward, ["left_key", "right_key"], ["decided_at", "decision"]).select("left_key", "right_key", F.col("decision").alias("_told"), F.col("reviewer").alias("_by"))
    rules = latest(match_rules, ["signature"], ["item_id"]).select("signature", F.col("decision").alias("_rule"), F.col("item_id").alias("_item"))
    df = scored.join(told, ["left_key", "right_key"], "left").join(rules, "signature", "left")
    open_to = F.lit(True) if any_band else F.col("band") == "MEDIUM"
    steward_says = F.when(open_to & F.col("_told").isin("match", "no_match"), F.col("_told") == "match")
    rule_says = F.when((F.col("band") == "MEDIUM") & F.col("_rule").isNotNull(), F.col("_rule") == "match")
    by = F.when(steward_says.isNotNull(), F.concat(F.lit("steward:"), F.coalesce("_by", F.lit("")))).when(rule_says.isNotNull(), F.col("_item")).otherwise("rules")
    merge = F.coalesce(steward_says, rule_says, F.col("band") == "HIGH")
    if "ai_decision" in scored.columns:
        by = F.when((by == "rules") & F.col("ai_decision").isNotNull(), "rules+ai").otherwise(by)
    return df.select(*scored.columns, merge.alias("merge"), by.alias("decided_by"))


def with_opinions(scored: DataFrame, vendors: DataFrame, cache: DataFrame) -> DataFrame:
    """Bands guarded by an assistant's cached opinions (fingerprint, decision, confidence, created_at): only pairs
    of the grey zone may have one.  The old band stays as rule_band."""
    said = ("vendor_name", "tax_id", "city", "country_iso2")
    side = lambda s: vendors.dropDuplicates(["record_key"]).select(F.col("record_key").alias(f"{s}_key"), *[F.col(f).alias(f"_{s}_{f}") for f in said])
    df = scored.join(side("left"), "left_key").join(side("right"), "right_key")
    print_ = fingerprint([F.col(f"_left_{f}") for f in said], [F.col(f"_right_{f}") for f in said])
    told = latest(cache, ["fingerprint"], ["created_at", "decision"]).select("fingerprint", F.col("decision").alias("ai_decision"), F.col("confidence").alias("ai_confidence"))
    grey = (F.col("score") >= config.GREY_LOW) & (F.col("score") < config.GREY_HIGH)
    df = df.withColumn("fingerprint", F.when(grey, print_)).join(told, "fingerprint", "left").withColumnRenamed("band", "rule_band")
    new = guarded_band(F.col("score"), F.col("tax_conflict"), F.col("ai_decision"), F.col("ai_confidence"))
    return df.select(*[c for c in scored.columns if c != "band"], "rule_band", new.alias("band"), "fingerprint", "ai_decision", "ai_confidence")


def unanswered(with_cache: DataFrame, match_rules: DataFrame, limit: int) -> DataFrame:
    """Grey pairs without an opinion or a rule for their signature, most similar first: what may still be asked."""
    grey = with_cache.where(F.col("fingerprint").isNotNull() & F.col("ai_decision").isNull())
    return grey.join(match_rules.select("signature").distinct(), "signature", "left_anti").orderBy(F.desc("score"), "left_key", "right_key").limit(limit)


def review_queue(decided: DataFrame, limit: int | None = None) -> DataFrame:
    out = decided.where((F.col("band") == "MEDIUM") & (F.col("decided_by").isin("rules", "rules+ai")))
    out = out.orderBy(F.desc("score"), "left_key", "right_key")
    return out.limit(limit) if limit else out


def fuzzy_best(values: DataFrame, vocabulary: DataFrame, least: float = config.FUZZY_APPROVE) -> DataFrame:
    """(value, best, similarity): of each value the most similar word of the vocabulary with the same first letter
    and a length within 2; equal ones go to the smaller word.  An equi-join on the first letter and length."""
    near = values.select("value", F.substring("value", 1, 1).alias("first"), F.explode(F.sequence(F.length("value") - 2, F.length("value") + 2)).alias("size"))
    words = vocabulary.select("word", F.substring("word", 1, 1).alias("first"), F.length("word").alias("size"))
    scored = near.join(words, ["first", "size"]).withColumn("similarity", F.round(token_sort_ratio(F.col("value"), F.col("word")), 4))
    best = scored.where(F.col("similarity") >= least).groupBy("value").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "word")).alias("x"))
    return best.select("value", F.col("x.word").alias("best"), (-F.col("x.s")).alias("similarity"))


def top_per_group(df: DataFrame, by: str, n: int, order: list) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group and task before it shuffles."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
