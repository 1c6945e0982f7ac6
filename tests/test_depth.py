"""Searches, clusters, commits and streams of the engine at their bounds, against plain models."""

import datetime
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.operators import components, golden, learning, library, mapping_learner, matching, nearest, rules, sentinel, standardize
from quarrystone.plans import interval, landing, llm_client
from quarrystone.plans.engine import Engine
from quarrystone.sources import files, store, synth
from quarrystone.sources.scratch import written
from quarrystone.streaming import jobs


# --- nearest words ------------------------------------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def nearest_by_force(asked, words, k):
    return [(-s, w) for s, w in sorted((-(1.0 * (2 * lcs(asked, w)) / (len(asked) + len(w)) if asked or w else 0.0), w) for w in words)[:k]]


WORDS = st.text("ABCDE", min_size=1, max_size=9)


@settings(max_examples=100, deadline=None)
@given(WORDS, st.sets(WORDS, max_size=30), st.sets(WORDS, max_size=30), st.integers(1, 6))
def test_nearest_words_are_exact_over_shards(asked, first, second, k):
    found = nearest.LetterIndex(sorted(first)).nearest(asked, k, [])
    assert found == nearest_by_force(asked, first, k)
    assert nearest.LetterIndex(sorted(second - first)).nearest(asked, k, found) == nearest_by_force(asked, first | second, k)


def test_nearest_words_in_rounds(spark):
    r = random.Random(4)
    words = {"".join(r.choice("ABCDEFG") for _ in range(r.randint(1, 40))) for _ in range(60)}
    asked = [*sorted(words)[:5], "GGG", "ÄÖ", "A" * 300]
    df = nearest.nearest_words(spark.createDataFrame([(a,) for a in asked], "raw string"), spark.createDataFrame([(w,) for w in words], "token string"), 5, shard_words=20)
    assert {x["raw"]: [(t["similarity"], t["word"]) for t in x["top"]] for x in df.collect()} == {a: nearest_by_force(a, words, 5) for a in asked}
    none = nearest.nearest_words(df.select("raw"), spark.createDataFrame([], "token string"))
    assert all(x["top"] == [] for x in none.collect())


def test_abbreviations_find_their_words(spark):
    long = {"TECH": "TECHNOLOGIES", "MFG": "MANUFACTURING", "SVCS": "SERVICES", "INTL": "INTERNATIONAL"}
    core = [*long.values(), "LOGISTICS", "STEEL"]
    names = [f"{w} N{k}X" for k in range(12) for w in core] + [f"Solo {s} Ltd" for s in long] + ["Qqq Ltd"]
    v = spark.createDataFrame([(n, "London") for n in names], "vendor_name string, city_raw string")
    i = spark.createDataFrame([("USD",)], "currency_raw string")
    got = {r["raw"]: r for r in mapping_learner.learn(v, i, config.Mappings.seed()).where("domain = 'token'").collect()}
    vocabulary = [*core, "SOLO", *(f"N{k}X" for k in range(12))]  # in three names or more
    for short, word in long.items():
        want = nearest_by_force(short, vocabulary, 5)
        assert got[short]["options"] == [w for _, w in want] and want[0][1] == word
        assert (got[short]["canonical"], got[short]["confidence"], got[short]["source"]) == (word, round(want[0][0], 3), "rule")
    assert got["QQQ"]["canonical"] is None and len(got["QQQ"]["options"]) == 5  # nothing begins with its letter


# --- clusters -----------------------------------------------------------------------------------------------------
def sequential(edges, barred, nodes):
    """Cluster of each node: edges (a, b, score) one after the other."""
    parent, bars = {}, {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    members = {n: {n} for n in nodes}
    for a, b in barred:
        bars.setdefault(a, set()).add(b)
        bars.setdefault(b, set()).add(a)
    held = {n: set(bars.get(n, ())) for n in nodes}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        p, q = root(a), root(b)
        if p != q:
            if len(members[p]) < len(members[q]):
                p, q = q, p
            if not held[p] & members[q]:
                parent[q] = p
                members[p] |= members.pop(q)
                held[p] |= held.pop(q)
    return {x: min(m) for m in members.values() for x in m}


def clustered(spark, nodes, edges, barred, most_edges):
    n = spark.createDataFrame([(x,) for x in nodes], "record_key string")
    e = spark.createDataFrame(edges, "left_key string, right_key string, score double")
    c = spark.createDataFrame(sorted(barred), "left_key string, right_key string")
    got, judged = components.constrained_clusters(n, e, c, most_edges)
    return {r["record_key"]: r["cluster"] for r in got.collect()}, judged


@pytest.mark.parametrize("seed", [1, 2])
def test_contracted_clusters_equal_a_sequential_model(spark, seed):
    r = random.Random(seed)
    nodes = [f"k{x:03d}" for x in range(60)]
    edges = [(*r.sample(nodes, 2), r.randint(0, 30) / 30) for _ in range(220)]
    edges += edges[:5] + [("k001", "k001", 1.0)]  # repeated, and a loop
    barred = {tuple(r.sample(nodes, 2)) for _ in range(25)}
    got, judged = clustered(spark, nodes, edges, barred, 20)
    want = sequential(edges, barred, nodes)
    assert got == want
    assert Counter(tuple(x) for x in judged.collect()) == Counter((a, b, s, want[a] == want[b]) for a, b, s in edges)


def test_a_giant_component_is_contracted(spark, monkeypatch):
    r = random.Random(3)
    nodes = [f"k{x:05d}" for x in range(20000)]
    edges = [(nodes[x], nodes[x + 1], 0.5 + r.random() / 2) for x in range(19999)] + [(*r.sample(nodes, 2), round(r.random(), 3)) for _ in range(80001)]
    barred = {tuple(r.sample(nodes, 2)) for _ in range(40)}
    sizes, solve = [], components._in_order
    monkeypatch.setattr(components, "_in_order", lambda e, b: (sizes.append(e.groupBy("component").count().agg(F.max("count")).first()[0] or 0), solve(e, b))[1])
    got, _ = clustered(spark, nodes, edges, barred, 5000)
    assert got == sequential(edges, barred, nodes) and max(sizes) <= 5000


def test_components_by_rounds_equal_those_of_one_task(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    once, rounds = (sorted(map(tuple, components.components(df, small_edges=n).collect())) for n in (1 << 17, 0))
    assert once == rounds and len(once) > 300
    assert components.components(df.where("a < 0")).count() == 0


def test_master_keys_equal_choosing_one_after_the_other(spark):
    r = random.Random(5)
    for _ in range(2):
        votes = {(f"c{r.randrange(25):02d}", f"GRV-{r.randrange(18):06d}"): r.randint(1, 4) for _ in range(90)}
        size = {c: r.randint(1, 9) for c, _ in votes}
        used, want = set(), {}
        for c in sorted(size, key=lambda c: (-size[c], c)):
            if free := sorted((-v, k) for (x, k), v in votes.items() if x == c and k not in used):
                want[c] = free[0][1]
                used.add(free[0][1])
        df = spark.createDataFrame([(c, k, v, size[c]) for (c, k), v in votes.items()], "cluster string, master_key string, votes long, n long")
        assert {x["cluster"]: x["master_key"] for x in golden.settled_keys(df).collect()} == want


# --- medians and least similar names ------------------------------------------------------------------------------
def test_hot_medians_equal_percentiles(spark):
    r = random.Random(7)
    draw = {"even": lambda: r.choice([1.0, 2.0, 3.5, 9.25]), "wide": lambda: 10 ** r.uniform(-12, 12), "near": lambda: 1 + r.randrange(10**6) / 2**40, "odd": lambda: float("inf") if r.random() < 0.3 else r.random(), "inf": lambda: float("inf") if r.random() < 0.7 else 1.0}
    rows = [(k, f()) for k, f in draw.items() for _ in range(301 if k == "odd" else 300)] + [("few", 2.0), ("few", 4.0), ("none", -1.0), (None, 3.0), ("one", 5.0), ("one", 5.0), ("one", 8.0)]
    df = spark.createDataFrame(rows, "vendor_record_key string, amount double").repartition(5)
    got, want = ({x["vendor_record_key"]: (x["median"], x["history"], x["limit"]) for x in rules.outliers(df, hot_rows=n).collect()} for n in (2, 1 << 18))
    assert got == want and set(got) == {*draw, "one"}
    counts = df.where("amount > 0").groupBy("vendor_record_key", "amount").agg(F.count("*").alias("n")).dropna()
    fine = {x["vendor_record_key"]: x["median"] for x in rules.hot_medians(counts, "vendor_record_key", "amount", buckets=3).collect()}
    assert {k: fine[k] for k in want} == {k: v[0] for k, v in want.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, unique=True, max_size=8), st.lists(WORDS, unique=True, max_size=8), WORDS)
def test_least_similar_names_are_exact(one, two, pivot):
    like = lambda a, b: round(2 * lcs(a, b) / (len(a) + len(b)), 4)
    for second, pairs in ((two, [(a, b) for a in one for b in two]), (None, [(a, b) for n, a in enumerate(one) for b in one[n + 1 :]])):
        worst = min((like(a, b) for a, b in pairs), default=1.0)
        assert golden.least_similar(one, second, pivot, 0.6) == (worst if worst < 0.6 else None)


def test_alerts_of_vendors_with_many_names(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for g in range(5):
        base = "".join(r.choice("ABCDEFGH") for _ in range(12))
        for k in range(90):
            name = "".join(c if r.random() < 0.9 else r.choice("XYZ") for c in base)
            rows.append((f"S:{g}:{k:02d}", f"G{g}", "QQQQ WWWW EEEE" if (g, k) == (1, 50) else f"{name[:6]} {name[6:]}"))
    rows += [("S:9", "G0", None), ("S:8", "G7", "ALONE")]
    df = spark.createDataFrame(rows, "record_key string, master_key string, vendor_name_norm string").selectExpr("*", "CAST(NULL AS STRING) AS tax_id", "'IN' AS country_iso2", "CAST(NULL AS STRING) AS bank_token")
    xref, vendors = df.select("master_key", "record_key"), df.drop("master_key")
    monkeypatch.setattr(golden, "NAMES_BLOCK", 20)
    found = [sorted(map(tuple, golden.cluster_alerts(vendors, xref, few_names=n).collect())) for n in (3, 1000)]
    assert found[0] == found[1] and "G1" in {x[0] for x in found[0]}


# --- commits ------------------------------------------------------------------------------------------------------
def test_a_commit_is_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    one = lambda n: spark.createDataFrame([(n,)], "a long")
    for name in "xyz":
        s.write(name, one(0))
    rows = lambda t: [sorted(r["a"] for r in t.read(n).collect()) for n in "xyz"]

    def change(stop):
        with s.commit():
            for k, name in enumerate("xyz"):
                if k == stop:
                    raise OSError("stopped")
                s.append(name, one(k + 1))
                assert rows(store.Store(spark, s.root)) == [[0], [0], [0]]  # nobody else sees it
            assert rows(s) == [[0, 1], [0, 2], [0, 3]]
            if stop == 3:
                raise OSError("stopped")

    for stop in range(4):
        with pytest.raises(OSError):
            change(stop)
        assert rows(s) == rows(store.Store(spark, s.root)) == [[0], [0], [0]]
    create, s._create = s._create, lambda path, content: (_ for _ in ()).throw(OSError("stopped")) if "_commits" in path else create(path, content)
    with pytest.raises(OSError):
        change(4)  # at the mark itself
    s._create = create
    assert rows(s) == [[0], [0], [0]]
    change(4)
    assert rows(s) == rows(store.Store(spark, s.root)) == [[0, 1], [0, 2], [0, 3]]
    with s.commit(), s.commit():  # one commit
        s.write("new", one(5))
    for k in range(5):  # what unfinished commits wrote is removed in time
        s.write("x", one(k))
    assert s.tables() == ["new", "x", "y", "z"] and len(list((tmp_path / "t" / "x").iterdir())) <= 3


# --- streams ------------------------------------------------------------------------------------------------------
RULES = (
    sentinel.AlertRule("A1", "drop", "m", "drop_vs_previous", 1, "high"), sentinel.AlertRule("A2", "rise", "m", "rise_vs_previous", 2, "low"),
    sentinel.AlertRule("A3", "low", "n", "below", 3, "high"), sentinel.AlertRule("A4", "high", "n", "above", 7, "high"),
)
HISTORY = "run_at timestamp, object string, metric string, value double"


def at(minutes):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


def streamed(spark, folder, checkpoint, out):
    stream = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(str(folder))
    jobs.into_table(jobs.change_alerts(stream, RULES, "30 minutes"), str(out), str(checkpoint)).awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_alerts_equal_those_of_the_whole_history(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(at(10 * k), o, m, float(r.randint(0, 9))) for k in range(24) for o in "ab" for m in "mn"] + [(at(50), "a", "m", 4.0), (None, "a", "m", 1.0), (at(60), "a", "n", None)]
    rows.sort(key=lambda x: (x[0] or at(0)) + datetime.timedelta(minutes=r.randint(0, 25)))  # out of order inside the delay
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [[(at(10000), "", "", 0.0)]]
    folder, checkpoint, out = tmp_path / "in", tmp_path / "cp", tmp_path / "out"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, HISTORY).coalesce(1).write.mode("append").parquet(str(folder))
        if n in (1, 2, len(parts) - 1):  # the query stops and starts again
            streamed(spark, folder, checkpoint, out)
    want = sentinel.history_alerts(spark.createDataFrame(rows, HISTORY).dropna(), RULES)
    got = spark.read.parquet(str(out))
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect())) and got.count() > 5


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "in", tmp_path / "cp", tmp_path / "out"
    for part in ([(at(0), "a", "m", 5.0)], [(at(100), "a", "m", 5.0)], [(at(40), "a", "m", 0.0), (at(90), "a", "m", 9.0)], [(at(9999), "", "", 0.0)]):
        spark.createDataFrame(part, HISTORY).coalesce(1).write.mode("append").parquet(str(folder))
        streamed(spark, folder, checkpoint, out)
    got = [(r["run_at"], r["alert_id"], r["value"]) for r in spark.read.parquet(str(out)).orderBy("run_at").collect()]
    assert got == [(at(90), "A2", 4.0), (at(100), "A1", -4.0)]  # 40 is later than the delay, 90 isn't


# --- interval runs ------------------------------------------------------------------------------------------------
def at_once(engine, raw, max_block):
    """Pairs, and golden vendors by their members, of one full run of the steps."""
    vendors = standardize.vendors(raw, engine.mappings())
    pairs = engine.judged(vendors, matching.candidate_pairs(vendors, max_block))
    edges = pairs.where("merge").select("left_key", "right_key", "score")
    clusters, _ = components.constrained_clusters(vendors, edges, library.cannot_links(engine.history()))
    return pairs, *golden.build(vendors, clusters)


def shown(pairs, gold, xref):
    members = {}
    for r in xref.collect():
        members.setdefault(r["master_key"], []).append(r["record_key"])
    rows = {tuple(sorted(members[r["master_key"]])): tuple(str(v) for k, v in sorted(r.asDict().items()) if k != "master_key") for r in gold.collect()}
    assert len(rows) == len(members)
    return {(r["left_key"], r["right_key"]): (r["score"], r["merge"], r["decided_by"]) for r in pairs.collect()}, rows


def stored(engine):
    return shown(*(engine.store.read(t) for t in ("silver_match_pairs", "gold_vendor", "gold_vendor_xref")))


def test_batches_equal_one_run(spark, tmp_path):
    raw, _ = synth.vendors(spark, 25, 6)
    raw = raw.drop("true_vendor").orderBy("record_key").cache()
    e = Engine(spark, str(tmp_path))
    limit = 5  # so that blocks become too large
    keys = sorted(r["record_key"] for r in raw.collect())
    random.Random(1).shuffle(keys)
    part = lambda ks: raw.where(F.col("record_key").isin(ks))
    third = len(keys) // 3
    n = interval.match_batch(e, part(keys[:third]), 0, max_block=limit)
    assert n and interval.match_batch(e, part(keys[:third]), 0, max_block=limit) == 0  # handed over again
    assert stored(e) == shown(*at_once(e, part(keys[:third]), limit))
    interval.match_batch(e, part(keys[third:]), 1, max_block=limit)
    assert stored(e) == shown(*at_once(e, raw, limit))
    # records change: one moves to another block and name, one gets another's data
    a, b, c = keys[0], keys[1], keys[2]
    other = raw.where(F.col("record_key") == c).drop("record_key", "source", "source_vendor_id")
    moved = part([a]).withColumn("vendor_name", F.lit("Zebra Works")).withColumn("tax_id_raw", F.lit("")).withColumn("phone_raw", F.lit("0091 7777777777"))
    taken = part([b]).select("record_key", "source", "source_vendor_id").crossJoin(other).select(raw.columns)
    interval.match_batch(e, moved.select(raw.columns).unionByName(taken), 2, max_block=limit)
    now = written(raw.where(~F.col("record_key").isin(a, b)).unionByName(moved.select(raw.columns)).unionByName(taken), "now")
    assert stored(e) == shown(*at_once(e, now, limit))
    # a steward keeps a record apart: everything is read again
    group = max((m for m in stored(e)[1]), key=len)
    e.unmerge(group[0], "me")
    interval.match_batch(e, part(keys[3:4]), 3, max_block=limit)
    assert stored(e) == shown(*at_once(e, now, limit)) and group not in stored(e)[1]


def test_intervals_of_a_stream(spark, tmp_path):
    raw, _ = synth.vendors(spark, 8, 3)
    raw = raw.drop("true_vendor").cache()
    e, folder = Engine(spark, str(tmp_path / "lake")), str(tmp_path / "in")
    for source in config.SOURCES[:2]:
        raw.where(F.col("source") == source).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(raw.schema).parquet(folder)
        interval.at_intervals(e, stream, str(tmp_path / "cp")).awaitTermination()
    assert [(r["number"], r["records"]) for r in e.store.read("match_batches").orderBy("number").collect()] == [(n, raw.where(F.col("source") == s).count()) for n, s in enumerate(config.SOURCES[:2])]
    assert stored(e) == shown(*at_once(e, raw.where(F.col("source").isin(*config.SOURCES[:2])), config.MAX_BLOCK))


# --- learning -----------------------------------------------------------------------------------------------------
def test_newton_finds_where_the_gradient_vanishes(spark):
    r = np.random.default_rng(1)
    x = np.round(r.random((400, 3)), 1)
    x[:, 2] = x[:, 0] > 0.5
    y = (x @ [2.0, -1.0, 0.5] + r.normal(size=400) > 0.7).astype(int)
    for label in (y, (x[:, 0] > 0.45).astype(int)):  # the second is separable
        counts = Counter((*map(float, a), int(b)) for a, b in zip(x, label, strict=True))
        w = learning.newton(spark.createDataFrame([(*k, n) for k, n in counts.items()], "a double, b double, c double, label int, n long").coalesce(1), ["a", "b", "c"])
        z = np.c_[x, np.ones(400)]
        assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - label) + w * [1, 1, 1, 0]).max() < 1e-7


def test_a_registered_model_scores_the_same_when_read_again(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    r = random.Random(3)
    rows = [(f"a{k:03d}", f"b{k:03d}", round(r.random(), 4), *(r.random() < 0.5 for _ in range(5))) for k in range(120)]
    pairs = spark.createDataFrame(rows, "left_key string, right_key string, name_similarity double, tax_eq boolean, tax_conflict boolean, city_eq boolean, phone_eq boolean, domain_eq boolean")
    e.store.write("silver_match_pairs", pairs)
    told = [(x[0], x[1], "match" if x[2] + x[3] + r.random() > 1.3 else "no_match", "me", "", datetime.datetime(2026, 1, 1)) for x in rows]
    e.store.write("steward_decisions", spark.createDataFrame(told[:10], library.DECISIONS))
    assert not e.train()["trained"]
    with pytest.raises(KeyError):
        e.model()
    e.store.append("steward_decisions", spark.createDataFrame(told[10:], library.DECISIONS))
    out = e.train()
    again = Engine(spark, str(tmp_path)).model()
    assert again["version"] == out["version"] == 1 and again["snapshots"] == {"silver_match_pairs": 1, "steward_decisions": 2} and again["metrics"]["rows"] == 120
    assert e.train()["version"] == 2 and e.model(version=1) == again
    got = {x["left_key"]: x["p"] for x in pairs.select("left_key", learning.match_probability(again).alias("p")).collect()}
    for x in rows:
        z = sum(out["coefficients"][f] * float(v) for f, v in zip(learning.FEATURES, x[2:], strict=True)) + out["intercept"]
        assert abs(got[x[0]] - 1 / (1 + math.exp(-z))) < 1e-12


# --- keyed merges, landing ----------------------------------------------------------------------------------------
def test_merges_write_only_the_buckets_they_change(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    want = {k: f"v{k}" for k in range(200)}
    s.merge("x", ["k"], make(list(want.items())))
    before = set(s.snapshots("x"))
    s.merge("x", ["k"], make([(3, "new"), (500, "more")]), make([(7, "")]))
    want |= {3: "new", 500: "more"}
    del want[7]
    assert {r["k"]: r["v"] for r in s.read("x").collect()} == want and s.read("x").count() == len(want)
    assert 1 <= len(set(s.snapshots("x")) - before) <= 3 and len(before & set(s.snapshots("x"))) >= len(before) - 3
    s.merge("x", ["k"], make([]), make([]))
    s.merge("x", ["k"], make([]), s.read("x"))
    assert s.read("x").count() == 0 and s.read("x").columns == ["k", "v"] and s.version("x") == 3
    s.merge("x", ["k"], make([(1, "a")]))
    assert [tuple(r) for r in s.read("x").collect()] == [(1, "a")]


def test_a_bad_batch_comes_and_goes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    made = landing.generate(e, 12, 60, 5)
    state = lambda: {t: Counter(map(str, e.store.read(t).drop("run_id", "confidence").collect())) for t in ("silver_vendor", "silver_invoice", "silver_dq_failures", "dq_scorecard", "gold_vendor", "gold_vendor_xref", "gold_spend_fact", "seeded_defects")}
    e.run()
    first = state()
    assert e.store.read("silver_invoice").count() == made["invoice_records"] == 60
    n = landing.inject_bad_batch(e, 40)
    assert landing.inject_bad_batch(e, 40) == n  # replaced
    caught = e.run()
    assert caught["records"] == sum(first["silver_vendor"].values()) + 60 + n and state() != first
    defects = e.store.read("seeded_defects")
    assert defects.where("record_key LIKE '%:BAD%'").count() == n
    bad = defects.where("record_key LIKE '%:BAD%' AND expected_rule <> 'A01'")
    flags = e.store.read("silver_dq_failures").withColumnRenamed("rule_id", "expected_rule")
    assert bad.join(flags, ["record_key", "expected_rule"], "left_anti").count() == 0  # all of them are found
    assert landing.remove_bad_batch(e) and not landing.remove_bad_batch(e)
    e.run()
    assert state() == first


# --- many mappings ------------------------------------------------------------------------------------------------
def test_mappings_by_join_equal_those_in_expressions(spark):
    r = random.Random(6)
    names = ["Apex STEL Works Ltd", "Apex Steel", "MAYBE Lmtd", "LMTD", None, "", "a.b.c w7 W7", "W12 w999 none"] + [f"W{r.randrange(900)} Works {k}" for k in range(40)]
    cities = ["bombay", " Bombay ", "C7", "c8", None, "", "unknown town", "Mumbai"]
    raw, _ = synth.vendors(spark, 30, 4)
    raw = raw.drop("true_vendor").withColumn("_n", F.pmod(F.xxhash64("record_key"), F.lit(len(names))).cast("int"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod(F.col("_n"), F.lit(len(values))).cast("int"))
    raw = raw.withColumns({"vendor_name": pick(names), "city_raw": pick(cities)}).drop("_n")
    inv = spark.createDataFrame([(f"i{k}", "ERP_A", "1", "2", "ERP_A:2", "20250101", "5", c) for k, c in enumerate(["usd", "K3", " k4", "", None, "XXX"])], "record_key string, source string, invoice_no string, source_vendor_id string, vendor_record_key string, invoice_date_raw string, amount_raw string, currency_raw string")
    items = [("token", f"W{k}", f"WORD{k % 30}") for k in range(900)] + [("token", "STEL", "STEEL"), ("token", "LMTD", config.LEGAL_MARK), ("city", "BOMBAY", "Mumbai")]
    items += [("city", f"C{k}", "London") for k in range(50)] + [("currency", f"K{k}", "EUR") for k in range(10)]
    rows = [(2, f"MAP:{d}:{x}", "value_mapping", f'{{"canonical":"{c}","domain":"{d}","raw_value":"{x}"}}', "active", "s", 1.0, "me", datetime.datetime(2026, 1, 1), 1, "", "") for d, x, c in items]
    rows += [(1, "MAP:token:W7", "value_mapping", '{"canonical":"OLD","domain":"token","raw_value":"W7"}', "active", "s", 1.0, "me", datetime.datetime(2026, 1, 1), 1, "", "")]
    history = spark.createDataFrame(rows, library.SCHEMA)
    for base in (config.Mappings.seed(), config.Mappings.curated()):
        few, many = library.mappings(history, base, 10_000), library.mappings(history, base, 100)
        assert few.table is None and many.table is not None
        got = [(standardize.vendors(raw, m), standardize.invoices(inv, m), mapping_learner.learn(raw, inv, m)) for m in (few, many)]
        for a, b in zip(*got, strict=True):
            assert a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect()))
    names = {x["vendor_name_norm"] for x in got[1][0].collect()}
    assert {"APEX STEEL WORKS", "MAYBE", None, "ABC WORD7 WORD7"} <= names


# --- files --------------------------------------------------------------------------------------------------------
def test_catalogues_come_from_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("rules:\n  - id: R01\n    name: Tax\n    entity: vendor\n    type: regex\n    column: tax_id\n    pattern: '^A'\n    skip_null: true\n    elsewhere: x\n  - {id: R02, name: N, entity: invoice, type: range, column: amount, min: 1, max: 5}\n")
    (tmp_path / "a.json").write_text('{"rules": [{"id": "AL1", "name": "n", "metric": "pass_rate", "condition": "below", "threshold": 0.5, "severity": "low"}]}')
    found = files.rules(spark, str(tmp_path / "r.yaml"))
    assert found == (rules.Rule("R01", "Tax", "vendor", "regex", "tax_id", pattern="^A", skip_null=True), rules.Rule("R02", "N", "invoice", "range", "amount", low=1, high=5))
    alerts = files.alert_rules(spark, str(tmp_path / "a.json"))
    assert alerts == (sentinel.AlertRule("AL1", "n", "pass_rate", "below", 0.5, "low"),)
    e = Engine(spark, str(tmp_path / "lake"), catalogue=found, alerts=alerts)
    assert [r.id for r in e.rules()] == ["R01", "R02", "A01"]
    for text in ("rules: {}", "- 1", "rules:\n  - {id: R01}", "rules:\n  - &a {id: R, name: n, entity: e, type: t, column: c}\n  - *a"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            files.rules(spark, str(tmp_path / "bad.yaml"))


def test_decisions_exports_and_reports(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    assert e.read_decisions(str(tmp_path / "none.csv")) == 0 and e.export() == []
    (tmp_path / "d.csv").write_text("left_key,right_key,decision,reviewer,decided_at\nB:2,A:1,match,me,2026-01-02T03:04:05\nA:1,C:3,no_match,,\n")
    assert e.read_decisions(str(tmp_path / "d.csv")) == 2 and e.read_decisions(str(tmp_path / "d.csv")) == 0
    told = {(r["left_key"], r["right_key"]): (r["decision"], r["reviewer"], r["decided_at"]) for r in e.store.read("steward_decisions").collect()}
    assert told == {("A:1", "B:2"): ("match", "me", datetime.datetime(2026, 1, 2, 3, 4, 5)), ("A:1", "C:3"): ("no_match", "", None)}
    e.store.write("gold_vendor", spark.createDataFrame([("G1", ["a", "b"], None), ("G2", [], "x,y")], "master_key string, list array<string>, name string"))
    e._log("r", "run", "finished", '{"records": 3}', 3)
    paths = e.export(str(tmp_path / "out"))
    assert [p.rsplit("/", 2)[1:] for p in paths] == [["gold", "gold_vendor.csv"], ["reports", "metrics.json"]]
    rows = store.read_csv(spark, paths[0]).orderBy("master_key").collect()
    assert [r["list"] for r in rows] == ['["a","b"]', "[]"] and rows[1]["name"] == "x,y"
    assert json.loads((tmp_path / "out/reports/metrics.json").read_text()) == {"records": 3}
    odd = {1: (np.float64("nan"), np.int64(4), datetime.date(2026, 1, 2)), "t": datetime.datetime(2026, 1, 2, 3), "n": None, "d": {"x": {1}}, "p": float("inf")}
    assert files.json_safe(odd) == {"1": [None, 4, "2026-01-02"], "t": "2026-01-02T03:00:00", "n": None, "d": {"x": [1]}, "p": None}
    files.report(e.store, str(tmp_path / "r.json"), odd)
    files.report(e.store, str(tmp_path / "r.json"), [1])  # replaced
    assert json.loads((tmp_path / "r.json").read_text()) == [1]


def test_the_assistant_may_write_rules_and_advise(spark, tmp_path):
    answers = {}

    class Scripted:
        def complete_json(self, system, prompt, schema):
            return answers.get("rule" if schema is llm_client.RULE_SCHEMA else "advice")

    e = Engine(spark, str(tmp_path), assistant=Scripted())
    e.store.write("silver_vendor", spark.createDataFrame([("v1", "IN")], "record_key string, country_iso2 string"))
    e.store.write("invoice_context", spark.createDataFrame([(f"i{k}", "S", float(k)) for k in range(40)], "record_key string, source_system string, amount double"))
    say = lambda **more: {"name": "n", "entity": "invoice", "column": "amount", "type": "range", "pattern": None, "values": None, "min": 1, "max": None, "dimension": "validity", "severity": "high"} | more
    answers["rule"] = say()
    got = e.draft_rule("Amounts should be one or more")
    assert got["status"] == "previewed" and got["rule"]["low"] == 1.0 and got["rule"]["high"] is None and got["rule"]["severity"] == "high"
    for bad in (say(column="nope"), say(type="reference"), say(entity="x"), None, {}):  # then the sentence is read by the rules
        answers["rule"] = bad
        assert e.draft_rule("Good morning")["status"] == "not understood" and e.draft_rule("Invoice amount must be at least 1")["rule"]["low"] == 1.0
    pair = [("a", "b", "A", "B", 0.75, "MEDIUM", "x", False)]
    e.store.write("silver_match_pairs", spark.createDataFrame(pair, "left_key string, right_key string, left_name string, right_name string, score double, band string, explanation string, tax_conflict boolean"))
    assert e.recommend_pair("b", "a")["recommendation"] == "unsure"
    answers["advice"] = {"recommendation": "match", "rationale": "same name", "what_to_check": "tax id"}
    assert {k: e.recommend_pair("a", "b")[k] for k in answers["advice"]} == answers["advice"]
    answers["advice"] = {"recommendation": "maybe", "rationale": "?"}
    assert e.recommend_pair("a", "b")["recommendation"] == "unsure"


def test_reset_drops_what_was_there(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.store.write("old", spark.range(1).toDF("a"))
    landing.generate(e, 6, 20, 1)
    landing.inject_bad_batch(e, 5)
    made = landing.reset(e, 4, 10, 2)
    assert made["invoice_records"] == 10 and e.store.tables() == ["seeded_defects", "vendor_truth"]
    assert e.ingest()[1].count() == 10 and not landing.remove_bad_batch(e)
