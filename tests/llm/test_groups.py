"""Operators that compare documents: decontamination, near-dedup, repeated strings, top-k, packing, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path

from quarrystone.llm import decontaminate, hashing, minhash, packing, substrings, topk
from quarrystone.operators.components import components
from tests.llm.cases import awkward, documents, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def small(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- decontamination ----------------------------------------------------------------------------------------------
def contamination_by_force(docs, items, size=13):
    windows = {}
    for item, t in items:
        w = WORD.findall(small(t))
        for i in range(max(1, len(w) - size + 1)) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = {}
    for k, t in docs:
        w, hit, found = WORD.findall(small(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_matches_brute_force(spark):
    items = [(f"q{k}", prose(k, 30)) for k in range(6)] + [("short", "Zwei drei"), ("none", " .. "), ("null", None), (None, "zwei"), ("q1", prose(77, 20)), ("twin", prose(3, 30)), ("same", "aa " * 20)]
    texts = [prose(900 + k, 40) + " " + (items[k % 6][1].upper() if k % 3 else "ZWEI, drei!") + " " + prose(800 + k, 200 * (k % 2)) for k in range(18)]
    texts += [*awkward(), items[0][1][: len(items[0][1]) // 2], "aa " * 40, "the ZWEI-DREI"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = documents(spark, texts)
    got = decontaminate.contamination(docs, bench).collect()
    want = contamination_by_force(enumerate(texts), items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k, v in want.items() if not v[4]}


def test_clean_with_null_and_repeated_ids_at_any_size_of_the_benchmark(spark):
    bad, good = prose(1, 30), [prose(10 + k, 30, "klmnopqrst") for k in range(3)]
    docs = documents(spark, [bad, good[0], bad, good[1], good[2]], [None, None, 5, 5, 6]).withColumnRenamed("entity", "hash_")
    for more in (0, 400):
        bench = spark.createDataFrame([("a", bad), ("b", prose(2, 40)), *((f"m{k}", prose(1000 + k, 60)) for k in range(more))], "item_id string, text string")
        left = decontaminate.clean(docs, bench)
        assert left.columns == docs.columns
        assert sorted(r["text"] for r in left.collect()) == sorted(good)


def test_bitmap_never_loses_a_hash(spark):
    values = [k * 2654435761 - (1 << 61) for k in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "h long").cache()
    other = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    for most, least in ((28, 0.9), (15, 0.0)):
        found = hashing.Bitmap(table, "h", most)
        assert found.may_hold(np.array(values)).all() and 1 - found.may_hold(other).mean() >= least


def test_contamination_empty(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(documents(spark, awkward()), bench).collect())


# --- near duplicates ----------------------------------------------------------------------------------------------
def near_by_force(docs):
    sets = {}
    for k, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", small(t))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    part = {k: k for k in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = prose(r.random(), 1)
    return " ".join(w)


def test_near_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 8)  # so that pools have several blocks
    base, texts = [prose(k, 120) for k in range(4)], []
    for k in range(60):
        texts.append(changed(base[k % 4], 1 + k % 9, k))
    texts += [base[0], base[0].upper(), base[1] + " " + base[2], "one two", "One  TWO", prose(50, 80) + " " + base[3], *awkward()]
    texts += [base[3][: int(len(base[3]) * f)] for f in (0.5, 0.6, 0.7, 0.8, 0.9)]  # a chain
    got = minhash.near_components(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_force(enumerate(texts))


def test_near_components_hot_group_of_copies(spark):
    texts = [prose(1, 50)] * 400 + [changed(prose(1, 50), 1, k) for k in range(100)]
    got = minhash.near_components(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_force(enumerate(texts))


def test_near_components_null_repeated_and_no_rows(spark):
    t = prose(9, 30)
    docs = documents(spark, [t, t, t, None], [None, 5, 5, 5])
    got = sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in minhash.near_components(docs).collect())
    assert got == [(False, 5, True)] * 3 + [(True, 5, False)]
    assert minhash.near_components(documents(spark, [])).count() == 0
    kept = minhash.one_of_each(documents(spark, [t, t + " end", prose(3, 20), None]))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 2, 3}


def test_shingles_of_alternating_patterns_are_told_apart(spark):
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    texts = [f"{bits} p {bits} {bits} {bits} {bits}", f"{other} p {other} {other} {other} {other}"]
    assert [r["component_id"] for r in sorted(minhash.near_components(documents(spark, texts)).collect())] == [0, 1]


def test_texts_of_one_id_are_one_document(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = documents(spark, [a, b, changed(a, 1, 1), changed(b, 1, 2), prose(3, 9)], [5, 5, 6, 7, 8])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_components(docs).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]


def test_passage_in_many_different_documents(spark):
    passage = prose(77, 60)
    texts = [f"{prose(1000 + k, 22)} {passage} {prose(5000 + k, 22)}" for k in range(300)]
    texts += [changed(texts[k], 1, k) for k in range(0, 300, 7)]
    got = minhash.near_components(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_force(enumerate(texts))


def test_components_are_the_smallest_reachable_nodes(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    part = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in part.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- repeated strings ---------------------------------------------------------------------------------------------
def repeats_by_force(docs):
    seen, out = set(), {}
    for k, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[k] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    passage, r, texts = prose(70, 30), random.Random(6), []
    for k in range(40):
        cut = r.randrange(len(passage) // 2)
        texts.append(prose(k, r.randrange(60)) + passage[cut : cut + r.randrange(90, 200)] + prose(100 + k, r.randrange(40)))
    texts += [*awkward(), "ab" * 300, "x" * 350, "x" * 99, texts[3], "é" * 80, prose(5, 40) + passage + passage]
    r.shuffle(texts)
    got = substrings.without_repeats(documents(spark, texts)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == repeats_by_force(enumerate(texts))
    assert all(hashlib.sha256(bytes(x["kept"])).hexdigest() == x["kept_sha256"] for x in got)


def test_repeats_null_ids_and_no_rows(spark):
    t = prose(1, 60)
    got = substrings.without_repeats(documents(spark, [t, t, t], [4, None, 4])).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"] > 0) for x in got) == [(0, False), (4, True), (4, True)]
    assert substrings.without_repeats(documents(spark, [])).count() == 0


def test_suffix_sort_is_a_stable_sort():
    r = random.Random(2)
    for n in (0, 1, 2, 57):
        data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(400)), np.uint8)
        starts = np.array(r.sample(range(300), n), np.int64)
        sizes, groups = np.array([r.randrange(101) for _ in starts], np.int64), np.array([r.randrange(4) for _ in starts], np.int64)
        h = hashing.PrefixHash(data, hashing.Powers())
        order = substrings.suffix_sort(data, starts, sizes, groups, h)
        text = lambda i: data[starts[i] : starts[i] + sizes[i]].tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: (groups[i], text(i)))
        common = substrings.neighbours(order, starts, sizes, groups, h).tolist() if n else []
        for k in range(1, n):
            a, b = order[k - 1], order[k]
            same = next((i for i, (x, y) in enumerate(zip(text(a), text(b), strict=False)) if x != y), min(sizes[a], sizes[b]))
            assert common[k] == (same if groups[a] == groups[b] else -1)


def test_repeats_of_a_hot_anchor_meet_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_CLASSES", 4)
    line = prose(70, 25)
    texts = [prose(k, 12) + " " + line + " " + prose(300 + k % 7, 12) for k in range(60)]
    got = substrings.without_repeats(documents(spark, texts)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == repeats_by_force(enumerate(texts))


def test_segments_in_chunks_are_the_same_strings(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 64)
    data = np.frombuffer(prose(4, 200).encode(), np.uint8)
    _, _, first, n = substrings.segments(data, hashing.Powers())
    assert np.concatenate([f + np.arange(m) for f, m in zip(first, n, strict=True)]).tolist() == list(range(len(data) - 99))


# --- top-k --------------------------------------------------------------------------------------------------------
def topk_by_force(rows, queries, k):
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k] if q in ok else []
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("group", [8192, 60])
def test_topk_matches_brute_force(spark, group):
    r = np.random.default_rng(1)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(300)]
    v += [(300 + i, v[7][1]) for i in range(20)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, [0.0] * 8), (None, v[0][1])]
    rows = spark.createDataFrame([(i, x, 0, 0) for i, x in v], "vec_id long, embedding array<float>, rank int, score int")
    asked = rows.where("vec_id % 20 = 0 or vec_id > 395 or vec_id is null")
    got = {tuple(x) for x in topk.top_k(rows, asked, 5, group_rows=group, group_queries=10).collect()}
    assert got == topk_by_force(v, [i for i, _ in v if i is not None and (i % 20 == 0 or i > 395)], 5)


def test_topk_repeated_ids_and_large_values(spark):
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=6) * 10.0 ** (i % 4 * 5)]) for i in range(40)] + [(40, [1e30] * 6), (41, [-1e30, 1e30, 0.0, 0.0, 0.0, 0.0])]
    again = v[:9] + v[:3] + [(0, [1e9] * 6)]
    rows = spark.createDataFrame(v + again, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(rows, rows.where("vec_id % 10 = 0"), 5).collect()}
    kept = {}
    for i, x in v + again:
        kept[i] = min(kept.get(i, x), x)
    exact = {i: [math.floor(256 * y) for y in x] for i, x in kept.items()}
    want = set()
    for q in (0, 10, 20, 30, 40):
        score = lambda i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(exact[q], exact[i], strict=True))))  # noqa: B023, E731
        best = sorted((-score(i), i) for i in exact if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_topk_of_planted_neighbours_stops_early(monkeypatch):
    r = np.random.default_rng(5)
    rows = np.floor(r.normal(size=(2000, 16)) * 256)
    q = np.floor(rows[:20] * 3 + r.normal(size=(20, 16)) * 20)
    ids, scores = np.arange(2000), rows @ q.T
    j, i, s = topk.Block(ids, rows).top(np.arange(5000, 5020), q, 3, np.full(20, -np.inf))
    assert len(j) < 2000 * 20 / 4
    for k in range(20):
        assert sorted(zip(-s[j == k], i[j == k], strict=True))[:3] == sorted(zip(-scores[:, k].astype(int), ids, strict=True))[:3]


def test_topk_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], kind)
    assert topk.top_k(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 1.0])], kind)
    assert {tuple(x) for x in topk.top_k(two, two.where("vec_id = 0"), 5).collect()} == {(0, 1, 50, 256 * 128 + 512 * 256)}


# --- packing ------------------------------------------------------------------------------------------------------
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(packing.TOKENIZER))
    texts = [*awkward(), *(prose(k, 3 + 17 * k) for k in range(60)), "I'll say <|endoftext|> ok", "Σίσυφος ΣΑΣ", "\x1cx\x85y é İ"]
    rows = packing.pack_documents(documents(spark, texts), path(packing.TOKENIZER), 300).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(i, 300 * i, len(ids[300 * i : 300 * i + 300]), zlib.crc32(ids[300 * i : 300 * i + 300].tobytes())) for i in range(-(-len(ids) // 300))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by_doc[k], key=lambda r: r["piece"])] == want
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)])[:-1].tolist() and sum(r["length"] for r in s) <= 300
    assert len(by_seq) <= -(-sum(r["length"] for r in rows) // 300) + 1
    assert packing.pack_documents(documents(spark, []), path(packing.TOKENIZER)).count() == 0


def test_search_empties_bins():
    r = random.Random(3)
    for _ in range(5):
        lengths = [r.randint(1200, 2500) for _ in range(600)]
        first = packing.best_fit(lengths, 4096)
        found = packing.search(first, lengths, 4096)
        assert sorted(i for b in found for i in b) == list(range(600)) and all(sum(lengths[i] for i in b) <= 4096 for b in found)
        assert len(found) < len(first)


# --- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_texts import ALPHABETS

    langs = [sorted(ALPHABETS)[k % 4] for k in range(80)]
    clean = [prose(k, 60, ALPHABETS[v]) for k, v in enumerate(langs)]
    items = [(f"q{k}", prose(500 + k, 20, ALPHABETS["en"])) for k in range(5)]
    texts = [*clean, changed(clean[0], 1, 1), clean[1], "12 34 %%", None, items[2][1] + " x", clean[4] + " mail a.b@c.org"]
    documents(spark, texts, langs=[*langs, *["en"] * 6]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        left.append((name, {r["doc_id"]: r["text"] for r in docs.collect()}))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = [set(x) for _, x in left]
    assert sizes[0] == set(range(86)) - {82, 83}
    assert sizes[1] == sizes[0] - {80, 81, 85}  # near copies of 0, 1 and 4
    assert sizes[2] == sizes[1] - {84}
    assert all(left[3][1][k] == clean[k] for k in range(80))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == sizes[2] and Counter(r["doc_id"] for r in packed).most_common(1)[0][1] == 1
