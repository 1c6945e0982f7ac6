"""URL filters: rules first, then naive Bayes over the words that host and path names are made of.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's; the longest
rule that fits wins.  Rules are a parameter, a list somebody keeps by hand: they become one native expression that
goes through the list, so a few hundred are meant, and nothing of them is joined.

URLs that no rule decides are judged by their words.  Names are the runs of letters in host and path; a run of digits
is one name, `#`; what the rules name themselves is left out, as it only repeats them.  Names are mostly several words
written together: a unigram model over all words of all pages' visible text splits them by Viterbi.  The model never
travels whole: the distinct names' substrings of at most LONGEST letters are joined with the words' counts, and each
name's own arcs come back to it.  A piece that is no word costs as one of N * 10 ** letters.  Costs are whole millionths
of a nat, so sums don't depend on their order; ties go to fewer words, then to the longer last word.

The multinomial naive Bayes learns from all URLs that rules decide, whole (no sample): counts of words by verdict, plus
one for each word and one for the unseen.  All steps work on distinct names and distinct lists of names with their
numbers of pages, so a host that a third of all pages share is one row; only the last join meets every page, and Spark
splits its hot keys.

Defined cases: null URLs and those without :// have empty host and path, fit no rule and are judged by the classes'
sizes alone; so is every URL without names; without any decided page, or on equal scores, the verdict is allow; runs of
more than NAME_LETTERS letters, more than a host's label can hold, are one word; texts of any length are read whole;
repeated rows and null ids are judged each; other columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, discard, on, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
LONGEST, NAME_LETTERS = 20, 63
MICRO = 1e6
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z0-9#]+;"
_NAMES = r"\p{L}+|[0-9]+"


def _small(c: Column | str) -> Column:
    return F.translate(c, _CAPITALS, _SMALL)


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of pages: key, host, path, rule, verdict (null where no rule fits)."""
    part = lambda pattern: F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)
    out = pages.select(F.col(key), _small(part("://([^/?#]*)")).alias("host"), part("://[^/?#]*([^?#]*)").alias("path"))
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path) for r in order]
    first = lambda of: F.coalesce(*(F.when(f, of(r)) for f, r in zip(fits, order, strict=True)), F.lit(None).cast("string"))
    return out.withColumn("rule", first(lambda r: F.lit(r.name))).withColumn("verdict", first(lambda r: F.lit(r.verdict)))


def _names(rules: Sequence[Rule]) -> Column:
    """The names of host and path, without those of the rules."""
    every = F.regexp_extract_all(_small(F.concat_ws("/", "host", "path")), F.lit(f"({_NAMES})"), 1)
    every = F.transform(every, lambda n: F.when(n.rlike("^[0-9]"), F.lit("#")).otherwise(n))
    return F.filter(every, lambda n: ~n.isin(*sorted(rule_words(rules)), ""))


def rule_words(rules: Sequence[Rule]) -> set[str]:
    return {w for r in rules for w in re.findall(r"[^\W\d_]+", r.name.lower())}


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the visible text of all pages."""
    seen = F.regexp_replace(_small(F.coalesce(html, F.lit(""))), _HIDDEN, " ")
    words = pages.select(F.explode(F.regexp_extract_all(seen, F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return words.where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def cheapest(name: str, known: dict[tuple[int, int], int], log_n: float) -> list[str]:
    """The words of a name: known gives the costs of its pieces (start from 1, letters) that are words."""
    if len(name) > NAME_LETTERS or name == "#":
        return [name]
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # cost, words, minus the last word's letters
    for end in range(1, len(name) + 1):
        ways = []
        for size in range(1, min(LONGEST, end) + 1):
            cost, words, _ = best[end - size]
            own = known.get((end - size + 1, size))
            ways.append((cost + (round(MICRO * (log_n + size * math.log(10))) if own is None else own), words + 1, -size))
        best.append(min(ways))
    out, end = [], len(name)
    while end:
        out.append(name[end + best[end][2] : end])
        end += best[end][2]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names (name); counts: (word, n), total their sum."""
    log_n = math.log(max(total, 1))
    short = names.where((F.char_length("name") <= NAME_LETTERS) & (F.col("name") != "#"))
    pieces = short.select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("start"))
    pieces = pieces.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("name") - F.col("start") + 1))).alias("size"))
    pieces = pieces.withColumn("word", F.col("name").substr(F.col("start"), F.col("size")))
    costs = counts.select("word", F.round(F.lit(MICRO) * (F.lit(log_n) - F.log("n"))).cast("long").alias("cost"))
    # A name of NAME_LETTERS letters has at most NAME_LETTERS * LONGEST arcs.
    arc = F.array(F.col("start").cast("long"), F.col("size").cast("long"), "cost")
    arcs = pieces.join(costs, "word").groupBy("name").agg(F.collect_list(arc).alias("arcs"))

    def make():
        def work(cols):
            return [cols[0], [cheapest(n, {(a, s): c for a, s, c in arcs or ()}, log_n) for n, arcs in zip(*cols, strict=True)]]

        return work

    return arrow_map(names.join(arcs, "name", "left"), make, ["name", "arcs"], "name string, words array<string>")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of pages: key, host, path, rule, verdict (allow or block), score (log odds of block)."""
    counts = written(word_counts(pages, html), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = ruled(pages, rules, key, url).withColumn("_names", _names(rules)).withColumn("_key", F.array_join("_names", " "))
    decided = lambda verdict: F.sum((F.col("verdict") == verdict).cast("long"))
    lists = known.groupBy("_key").agg(F.first("_names").alias("names"), F.coalesce(decided("block"), F.lit(0)).alias("b"), F.coalesce(decided("allow"), F.lit(0)).alias("a"))
    lists = written(lists, "lists")
    names = lists.select("_key", "b", "a", F.explode("names").alias("name"))
    by_name = written(names.groupBy("name").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "names")
    split = written(segmented(by_name.select("name"), counts, total), "split")
    words = split.select("name", F.explode("words").alias("word")).join(by_name, "name")
    words = written(words.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "model")
    n = words.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum((F.col("b") + F.col("a") > 0).cast("long")).alias("v")).first()
    size = lists.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    slots = (n["v"] or 0) + 1
    bias = math.log((n["a"] or 0) + slots) - math.log((n["b"] or 0) + slots)
    prior = round(MICRO * (math.log((size["b"] or 0) + 1) - math.log((size["a"] or 0) + 1)))
    weights = words.select("word", F.round(F.lit(MICRO) * (F.log(F.col("b") + 1) - F.log(F.col("a") + 1) + F.lit(bias))).cast("long").alias("weight"))
    of_name = split.select("name", F.explode("words").alias("word")).join(weights, "word").groupBy("name").agg(F.sum("weight").alias("weight"))
    of_list = names.join(of_name, "name").groupBy("_key").agg(F.sum("weight").alias("weight"))
    scored = written(of_list, "scores")
    discard(counts, lists, by_name, split, words)
    score = F.coalesce("weight", F.lit(0)) + F.lit(prior)
    out = known.join(scored, "_key", "left")
    verdict = F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow"))
    return on(out.select(key, "host", "path", "rule", verdict.alias("verdict"), (score / MICRO).alias("score")), scored)
