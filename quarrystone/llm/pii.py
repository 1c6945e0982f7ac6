"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Everything is DataFrame functions.  The base patterns mark their matches inside the text; the lengths of the marked
pieces give the spans.  Each distinct value found is a protected entity.  Corpus co-occurrence tells how much of
an entity's information a term in the same text carries: with N distinct texts, n(e) and n(t) of them with the entity
and the term (a word of three letters or more, wherever it stands), and n(t, e) with both, the disclosure is

    pointwise mutual information / information content = ln(N n(t,e) / (n(t) n(e))) / ln(N / n(e)),

1 if the term never occurs without the entity.  Copies of a text count once in all four.  In texts that hold the
entity, terms at or above GENERALISE are replaced by a general word, those at or above REMOVE are taken out.
Counts need `SUPPORT` distinct texts, so a word that is merely rare isn't taken for a revealing one; the corpus
is only searched for terms that have that support beside an entity.

Defined cases: null text counts as empty; rows with equal or null ids are judged each; very long texts are read
whole, in time that grows with their length; empty tables give empty results; other columns may have any names;
the four marker characters used inside (U+FDD0 to U+FDD3) are read as U+FFFD, one for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import discard, on, written

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.97
#: Hash buckets by which words are filtered before a shuffle.
TERM_BUCKETS = 1 << 18
_OPEN, _SHUT, _SEP = "﷐", "﷑", "﷒"
# The contract's patterns, written so that Java neither retries from inside a run nor recurses.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_SEP}]*[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IP_FITS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"


#: Elements whose running sums are taken together.
_RUN = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of a non-empty array, all elements before it merged.  Runs of _RUN elements are merged
    first, so that the work stays near the length of the array."""

    def run(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int"))
        tops = F.transform(numbers, lambda r: F.aggregate(F.slice(v, r * _RUN + 1, F.lit(_RUN)), zero, merge))
        bases = _let(tops, lambda t: F.transform(numbers, lambda r: F.aggregate(F.slice(t, F.lit(1), r), zero, merge)))
        return _let(
            bases,
            lambda b: F.transform(
                F.sequence(F.lit(0), F.size(v) - 1),
                lambda i: F.aggregate(F.slice(v, i - i % _RUN + 1, i % _RUN), F.get(b, F.floor(i / _RUN).cast("int")), merge),
            ),
        )

    return _let(values, run)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the matches, by code points."""
    return _marked_spans(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"))


def _marked_spans(marked: Column) -> Column:
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def found(pieces: Column) -> Column:
        starts = _before(F.transform(pieces, F.length), F.lit(0), lambda a, n: a + n)
        # Every second piece is a match.
        return _let(
            starts,
            lambda at: F.transform(
                F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)),
                lambda i: F.struct(F.get(at, i).alias("s"), (F.get(at, i) + F.length(F.get(pieces, i))).alias("e"), F.get(pieces, i).alias("v")),
            ),
        )

    return F.when(F.contains(marked, F.lit(_OPEN)), _let(F.split(marked, f"[{_OPEN}{_SHUT}]"), found)).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _of_kind(spans: Column, no: int, entity) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(no).alias("k"), x["e"].alias("e"), entity(x["v"]).alias("v")))


def readable(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), f"{_OPEN}{_SHUT}{_SEP}﷓", "�" * 4)


def base_spans(docs: DataFrame, more: list[str]) -> DataFrame:
    """The columns more of docs (with t, a readable text) and base: array<struct<s, k, e, v>> of base spans by
    start, then kind; v is the entity's name."""
    t = F.col("t")
    cards = F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", _SEP)
    found = docs.select(
        *more,
        _spans(t, _EMAIL).alias("email"),
        F.filter(_spans(t, _IP), lambda x: x["v"].rlike(_IP_FITS)).alias("ip"),
        F.filter(_spans(cards, _CARD), lambda x: F.length(_digits(x["v"])).between(12, 19) & _luhn(_digits(x["v"]))).alias("card"),
        F.filter(_spans(t, _PHONE), lambda x: F.length(_digits(x["v"])).between(9, 15)).alias("phone"),
    )
    names = (F.lower, lambda v: v, _digits, _digits)
    kinds = [_of_kind(F.col(k), no, lambda v, k=k, f=f: F.concat(F.lit(f"{k}:"), f(v))) for no, (k, f) in enumerate(zip(KINDS, names, strict=False))]
    return found.select(*more, F.array_sort(F.concat(*kinds)).alias("base"))


def _words(t: Column) -> Column:
    """The distinct small-letter words of a text that may be terms."""
    return F.filter(F.array_distinct(F.split(F.lower(t), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) from found (h, t, base: the text's hash, the text if it has spans, its spans) and
    the whole corpus docs (h, t)."""
    total = found.select("h").distinct().count()
    one = found.where(F.size("base") > 0).select("h", "t", F.array_distinct(F.transform("base", lambda x: x["v"])).alias("held")).distinct()
    at = one.select("h", F.explode("held").alias("entity"))
    n_e = at.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    of = at.join(n_e, "entity").groupBy("h").agg(F.collect_list(F.struct("entity", "n_e")).alias("of"))
    both = one.select("h", "t").join(of, "h").select("of", F.explode(_words(F.col("t"))).alias("term")).select("term", F.explode("of").alias("x"))
    n_te = both.groupBy("x.entity", "x.n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    pairs = written(n_te, "pairs")
    wanted = written(pairs.select("term").distinct(), "wanted")  # few: what else the corpus says isn't shuffled
    # No more than TERM_BUCKETS numbers are broadcast; they keep other words out.  Copies go before words are counted,
    # so that counts are combined in each task.
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).alias("bucket")
    near = F.broadcast(wanted.select(bucket).distinct())
    said = docs.select("t").distinct().select(F.explode(_words(F.col("t"))).alias("term")).select("term", bucket).join(near, "bucket", "left_semi")
    n_t = said.groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(float(total))
    scored = pairs.join(n_t, "term").select("entity", "term", (F.ln(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.ln(n / F.col("n_e")), F.lit(1e-9))).alias("disclosure"))
    out = written(scored.where(F.col("disclosure") >= GENERALISE), "disclosures")
    discard(pairs, wanted)
    return out


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """kept: a struct of the columns keep of docs (all, if not given); t: the readable text (null where there is
    nothing); base and spans: array<struct<s, k, e, v>> of base, and of base and term spans by start, then kind; a
    term's v is "remove" or "generalise".  Texts with personal data are in a scratch table until it is discarded."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), readable(text).alias("t"))
    rows = rows.withColumn("h", F.unhex(F.substring(F.sha2(F.col("t").cast("binary"), 256), 1, 32)))
    found = base_spans(rows, ["kept", "h", "t"])
    found = written(found.select("kept", "h", F.when(F.size("base") > 0, F.col("t")).alias("t"), "base"), "personal")
    some, none = found.where(F.size("base") > 0), found.where(F.size("base") == 0)
    told = disclosures(found, rows)
    held = some.select("h", F.explode(F.array_distinct(F.transform("base", lambda x: x["v"]))).alias("entity")).distinct()
    of_entity = told.groupBy("entity").agg(F.collect_list(F.struct("term", F.col("disclosure").alias("d"))).alias("of"))
    terms = written(held.join(of_entity, "entity").groupBy("h").agg(F.flatten(F.collect_list("of")).alias("terms")), "terms")
    discard(told)
    marked = some.join(terms, "h", "left")
    here = F.array_intersect(F.transform("terms", lambda x: x["term"]), _words(F.col("t")))
    marked = marked.withColumn("here", F.array_sort(here))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("here", "|"), F.lit(r")(?!\p{L})"))
    hits = F.when(F.size("here") > 0, _marked_spans(F.regexp_replace("t", pattern, F.lit(f"{_OPEN}$0{_SHUT}"))))
    marked = marked.withColumn("hits", F.coalesce(hits, F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")))
    strong = F.transform(F.filter("terms", lambda x: x["d"] >= REMOVE), lambda x: x["term"])
    marked = marked.withColumn("strong", F.coalesce(strong, F.expr("cast(array() as array<string>)")))
    alone = F.filter("hits", lambda h: ~F.exists("base", lambda x: (x["s"] < h["e"]) & (h["s"] < x["e"])))
    added = _of_kind(alone, 4, lambda v: F.when(F.array_contains("strong", F.lower(v)), "remove").otherwise("generalise"))
    marked = marked.select("kept", "t", "base", F.array_sort(F.concat("base", added)).alias("spans"))
    return on(marked.unionByName(none.select("kept", "t", "base", F.col("base").alias("spans"))), found, terms)


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans.  Written, and what found reads is removed."""

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [number(k) for k in range(4)]
    out = written(found.select(F.col("kept")[key].alias(key), *count, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans")), "report")
    discard(found)
    return out


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with their columns, with entities replaced by their kind in angle brackets, revealing terms
    generalised to <term> or taken out.  Texts without either stay as they are.  Written, so that no personal data
    stays in scratch tables."""
    found = detect(docs, text)
    tag = lambda x: F.when(x["v"] == "remove", "").otherwise(F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), x["k"]), F.lit(">")))

    def rebuilt(spans: Column, chars: Column) -> Column:
        # A span that begins before the end of an earlier one is covered by that one's replacement.
        piece = lambda begin, end: F.array_join(F.slice(chars, begin + 1, F.greatest(F.lit(0), end - begin)), "")
        one = lambda at: F.transform(spans, lambda x, i: F.when(x["s"] >= F.get(at, i), F.concat(piece(F.get(at, i), x["s"]), tag(x))).otherwise(""))
        ends = F.transform(spans, lambda x: x["e"])
        return F.concat(F.array_join(_let(_before(ends, F.lit(0), lambda a, e: F.greatest(a, e)), one), ""), piece(F.array_max(ends), F.size(chars)))

    built = _let(F.col("spans"), lambda s: _let(F.split("t", ""), lambda c: rebuilt(s, c)))
    clean = F.when(F.size("spans") > 0, built).otherwise(F.col("kept")[text])
    out = written(found.select(*[clean.alias(c) if c == text else F.col("kept")[c].alias(c) for c in docs.columns]), "sanitised")
    discard(found)
    return out
