"""Secret scanning with an incremental blob ledger.

Every historical version of a path (a row of documents: its id is the path) is content-addressed by the SHA-256 of
its text.  The ledger holds, for each blob, the rule versions it was scanned with and what they found.  A scan
takes one copy of each blob that lacks a current rule version and runs only the missing rules; findings are
appended to the ledger and joined back to every path that has the blob.  If little is new, the join that fetches
the texts is small enough for Spark to broadcast its ids, and no text is shuffled.

Rules: assign, access and hex are the base; key files, web tokens and two vendors' token formats are added.

Defined cases: null text is the empty blob; copies share one scan; rows with equal or null ids are reported each;
very long texts are scanned whole, key blocks of any length and with any header lines among them; other columns are
ignored; empty tables give empty results; a rule whose version is raised is run again on every blob, the others aren't.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, new_path, written


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: re.Pattern
    hints: tuple[str, ...]  # one of them is in the small-letter text of any match; none: no such hint
    fits: Callable[[re.Match], bool]
    closing: re.Pattern | None = None  # the span goes on to the next match of it, if pattern doesn't match again before

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, small: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in small for h in self.hints):
            return []
        if not self.closing:
            return [m.span() for m in self.pattern.finditer(text) if self.fits(m)]
        marks = sorted([(m.start(), m.end(), True) for m in self.pattern.finditer(text) if self.fits(m)] + [(m.start(), m.end(), False) for m in self.closing.finditer(text)])
        return [(a[0], b[1]) for a, b in pairwise(marks) if a[2] and not b[2]]


def _any(m: re.Match) -> bool:
    return True


#: In the order in which kinds are listed; the first three are the base.
RULES = (
    Rule(
        "assign", 1,
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        ("passw", "secret", "token", "api"), lambda m: len(m[2]) >= 8,
    ),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), ("akia",), lambda m: len(m[0]) >= 16),
    Rule("hex", 1, re.compile(r"[0-9a-f]{32,}"), (), _any),
    Rule("pem", 2, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("private key-----",), _any, re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")),
    Rule("jwt", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("eyj",), _any),
    Rule("github", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _any),
    Rule("slack", 1, re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), ("xox",), _any),
)
BASE_KINDS = 3
_LEDGER = "blob binary, rules array<string>, spans array<struct<s:int,k:string,e:int>>"


def scan_text(text: str, rules: list[Rule]) -> list[tuple[int, str, int]]:
    small = text.lower()
    return sorted((a, r.kind, b) for r in rules for a, b in r.spans(text, small))


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def new_ledger(spark) -> str:
    """The path of an empty ledger in the shared folder."""
    path = new_path(spark, "ledger")
    spark.createDataFrame([], _LEDGER).write.parquet(path)
    return path


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger (a Parquet path that all executors share) up to date with docs and give, per row of docs,
    key and spans: array<struct<s, k, e>>, by start, then kind in the order of the rules."""
    spark = docs.sparkSession
    seen = spark.read.schema(_LEDGER).parquet(ledger)
    by_name = {r.name: r for r in rules}
    versions = written(docs.select(F.col(key), _blob(text).alias("blob")), "versions")
    covered = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("covered"))
    current = F.array(*map(F.lit, by_name))
    blobs = versions.groupBy("blob").agg(F.min(F.col(key)).alias("path"))
    missing = F.array_except(current, F.coalesce("covered", F.expr("cast(array() as array<string>)")))
    due = written(blobs.join(covered, "blob", "left").select("blob", "path", missing.alias("missing")).where(F.size("missing") > 0), "due")
    texts = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("own", _blob("text"))
    texts = texts.join(due, texts["path"].eqNullSafe(due["path"]) & (texts["own"] == due["blob"])).select("blob", "text", "missing")

    def make():
        def work(cols):
            done, out = set(), [[], [], []]
            for blob, t, names in zip(*cols, strict=True):
                if blob not in done:
                    done.add(blob)
                    found = scan_text(t, [by_name[n] for n in names])
                    for column, v in zip(out, (blob, names, [{"s": a, "k": k, "e": b} for a, k, b in found]), strict=True):
                        column.append(v)
            return out

        return work

    arrow_map(texts, make, ["blob", "text", "missing"], _LEDGER).write.mode("append").parquet(ledger)
    live = F.transform(F.array(*map(F.lit, by_name)), lambda n: F.split_part(n, F.lit("@"), F.lit(1)))
    place = lambda k: F.array_position(live, k)
    ledgered = spark.read.schema(_LEDGER).parquet(ledger).where(F.size("spans") > 0).join(blobs.select("blob"), "blob", "left_semi")
    # An older version's findings of a kind give way to those of the current one.
    ledgered = ledgered.withColumn("kinds", F.transform(F.array_intersect("rules", current), lambda n: F.split_part(n, F.lit("@"), F.lit(1))))
    kept = F.filter("spans", lambda x: F.array_contains("kinds", x["k"]))
    ordered = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), place(x["k"]).alias("at"), x["k"].alias("k"), x["e"].alias("e")))))))
    found = ledgered.groupBy("blob").agg(ordered.alias("spans"))
    none = F.expr("cast(array() as array<struct<s:int,at:long,k:string,e:int>>)")
    return versions.join(found, "blob", "left").select(key, F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans."""

    def number(at: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["at"] == at + 1)).cast("long").alias(f"n_{RULES[at].kind}")

    base = F.filter("spans", lambda x: x["at"] <= BASE_KINDS)
    return found.select(key, *map(number, range(BASE_KINDS)), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
