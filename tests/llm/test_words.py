"""URL filters, spelling variants and the conversation trie against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import conversations, spelling, urls
from tests.llm.cases import documents, prose


def one_edit(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def variants_by_force(rows):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({a: a + 32 for a in range(65, 91)})
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    letters, out = {c for w in n for c in w}, {}
    for w, c in n.items():
        near = [v for v in one_edit(w, letters) if v in n]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [c, len(near), best if best and n[best] >= 5 * c else None]
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (c, k, f, f and n[f], root(w)) for w, (c, k, f) in out.items()}


def found_variants(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abñ", min_size=0, max_size=6), max_size=40), st.sets(st.text("abñ", min_size=0, max_size=6), max_size=40))
def test_automata_accept_each_neighbour_once(words, held):
    as_bytes = lambda ws: sorted(w.encode("latin-1") for w in ws)
    mine, trie = as_bytes(words), spelling.Trie.built(as_bytes(held), list(range(len(held))))
    a, b = spelling.Trie.unpacked(trie.packed()).neighbours(mine)
    got = Counter((mine[i].decode("latin-1"), trie.word(j)) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert got == Counter((w, v) for w in words for v in held & one_edit(w, "abñ"))


@pytest.mark.parametrize("shard_words, round_shards", [(1 << 17, 4), (7, 2)])
def test_variants_by_force(spark, shard_words, round_shards):
    r = random.Random(3)
    stems = [prose(k, 1, "abcdeé") * 2 + "zz" for k in range(12)]
    texts = [" ".join(r.choice(stems) if r.random() < 0.8 else r.choice(sorted(one_edit(r.choice(stems), "ab"))) for _ in range(60)) for _ in range(60)]
    common = "Schifffahrt " * 400 + "Schiffahrt " * 60 + "Schifahrt " * 9
    rows = [*enumerate(texts), (None, "Straße STRAẞE straße " * 9), (5, common), (5, common), (70, "x" * 30000 + " ÄPFELN äpfeln Äpfeln×÷ " * 5), (71, None), (72, ""), (73, "a " * 300)]
    docs = documents(spark, [t for _, t in rows], [k for k, _ in rows]).selectExpr("*", "'w' AS word", "1 AS n")
    want = variants_by_force(rows)
    assert want["schifahrt"][4] == "schifffahrt" and want["schifahrt"][2] == "schiffahrt"  # a chain
    assert found_variants(spelling.variants(docs, shard_words=shard_words, round_shards=round_shards)) == want


def test_variants_of_nothing(spark):
    assert found_variants(spelling.variants(documents(spark, []))) == {}
    assert found_variants(spelling.variants(documents(spark, ["short words only here", None]))) == {}


def trie_by_force(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out, children = {}, defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    own = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    saved, leaves = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += own[n]
            leaves[n[:d]] += not children[n]
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))
        out[min(m), len(n)] = (min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, x string, leaf string"


def conversation_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for k in range(r.randint(1, 6)):
            said = "hello there friend" if k == 0 and r.random() < 0.4 else prose(r.randint(0, 2), 3)
            rows.append((c, k, "ua"[k % 2], said))
    r.shuffle(rows)
    return rows


def test_prefix_trie_by_force(spark):
    same = [(1000 + c, k, "u", f"turn {k}") for c in range(90) for k in range(4)]  # a large group of copies
    long = [(2000, k, "u", f"step {k % 3}") for k in range(700)]  # one conversation in many blocks
    odd = [(-7, 0, "u", "a"), (-20, 0, "u", "b"), (3001, None, None, None), (3001, None, "u", ""), (3001, 2, "u", None), (3001, 2, "u", None), (3002, 5, "u", "tie b"), (3002, 5, "u", "tie a"), (None, 0, "u", "nobody's"), (3003, 0, "u", "x" * 100000 + " y")]
    lone = [(c, 0, "u", "alone") for c in range(4001, 4017)]  # bases are absent: some are left without turns
    rows = conversation_rows(1, 150) + same + long + odd + lone
    df = spark.createDataFrame([(*r, 9, "x", "l") for r in rows], CONVERSATIONS).repartition(7)
    want = trie_by_force(rows)
    assert any(not p for p in (v[1] - 1 for v in want.values()))
    assert found_trie(conversations.prefix_trie(df)) == want


def test_prefix_trie_small(spark):
    make = lambda rows: spark.createDataFrame([(*r, 9, "x", "l") for r in rows], CONVERSATIONS)
    assert found_trie(conversations.prefix_trie(make([]))) == {}
    assert found_trie(conversations.prefix_trie(make([(None, 1, "u", "a")]))) == {}
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "u", "gone") for c in turnless]
    got = found_trie(conversations.prefix_trie(make(rows)))
    assert got == trie_by_force(rows) == {(turnless[0], 0): (None, len(turnless), 0, 1, 0, hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest())}


def test_ends_of_a_hot_node_are_hashed_in_chunks(spark, monkeypatch):
    ids = list(range(-500, 5000, 3))
    rows = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 8)], "x long, y long, conv long").repartition(5)
    monkeypatch.setattr(conversations, "CHUNK_IDS", 7)
    got = {(r["x"], r["y"]): r["ends_sha256"] for r in conversations._ends_hash(rows).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"8").hexdigest()}


PAGES = "page_id long, url string, html string, host int, score string, _key int"
HTML = "<html><style>badstyle { }</style><p>Free bets today</p><b>CASINO</b> win win the track of ads &amp; more<script>var freebets = 1</script> good news garden</html>"


def split_by_force(name, counts):
    """Every way to cut a name into words of at most 20 letters; the best one."""
    total = sum(counts.values())
    log_n = math.log(total)
    cost = lambda w: round(1e6 * (log_n - math.log(counts[w]) if w in counts else log_n + len(w) * math.log(10)))

    def ways(rest):
        if not rest:
            yield []
        for k in range(1, min(20, len(rest)) + 1):
            for more in ways(rest[k:]):
                yield [rest[:k], *more]

    return min(ways(name), key=lambda ws: (sum(map(cost, ws)), len(ws), [-len(w) for w in reversed(ws)]))


def pages(spark, links):
    return spark.createDataFrame([(k, u, HTML if k % 3 else None, 1, "s", 2) for k, u in enumerate(links)], PAGES)


LINKS = [
    "http://freebets.example.net/x/1", "http://casinowin.example.net/win/22", "https://goodnews.example.org/fr/garden", "http://GARDEN.example.org/fr/", "http://goodnewsgarden.example.net/en/9",
    "http://freecasino.other.com/es/1", "http://gardennews.other.com/es/1", "http://example.com/de/", "http://notexample.com/de/win", "http://a.b.example.com/de/x", "http://example.com/DE/x", "x://net/", "x://net", "x://org/fr/?q=/de/",
    "no scheme at all", None, "", "http://", "http://h?x://y/z", "http://h#a", "HTTP://U:P@Example.NET:80/en/", "http://xn--bcher-kva.example/", "http://bücher.example/ÄÖ", "a://b://c/d", "http://" + "longname" * 9 + ".com/" + "ad" * 5000, "http://freebets.example.net/x/1",
]


def test_rules(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.ruled(pages(spark, LINKS)).collect()}
    small = lambda s: s.translate({a: a + 32 for a in range(65, 91)})
    for k, u in enumerate(LINKS):
        m = re.search("://([^/?#]*)([^?#]*)", u or "")
        host, path = (small(m[1]), m[2]) if m else ("", "")
        fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert got[k] == (host, path, best and best.name, best and best.verdict)
    assert got[4][2:] == ("example.net/en/", "allow") and got[11][2] == "net/" and got[12][2] is None and got[8][2] is None


def test_url_filter_by_force(spark):
    df = pages(spark, LINKS)
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    text = " ".join(re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z0-9#]+;", " ", HTML.lower()) for k in range(len(LINKS)) if k % 3)
    counts = Counter(re.findall("[a-z]+", text))
    assert "badstyle" not in counts and "amp" not in counts
    ruled = {r["page_id"]: r["verdict"] for r in urls.ruled(df).collect()}
    words = {}
    for k, r in got.items():
        names = re.findall(r"[^\W\d_]+|[0-9]+", (r["host"] + "/" + r["path"]).translate({a: a + 32 for a in range(65, 91)}))
        names = ["#" if n[0].isdigit() else n for n in names if n not in urls.rule_words(urls.RULES)]
        words[k] = [w for n in names for w in ([n] if len(n) > 20 or n == "#" else split_by_force(n, counts))]
    assert words[0] == ["free", "bets", "x", "#"] and words[4] == ["good", "news", "garden", "#"] and words[24][0] == "longname" * 9
    c = {v: Counter(w for k, ws in words.items() if ruled[k] == v for w in ws) for v in ("block", "allow")}
    slots, size = len(c["block"] | c["allow"]) + 1, Counter(ruled.values())
    log_p = lambda v, w: math.log((c[v][w] + 1) / (sum(c[v].values()) + slots))
    for k, r in got.items():
        score = math.log((size["block"] + 1) / (size["allow"] + 1)) + sum(log_p("block", w) - log_p("allow", w) for w in words[k])
        assert abs(r["score"] - score) < 1e-4
        assert r["verdict"] == (ruled[k] or ("block" if r["score"] > 0 else "allow"))
    assert got[5]["verdict"] == "block" and got[6]["verdict"] == "allow"  # by their words alone


def test_url_filter_without_rows_rules_or_text(spark):
    assert urls.judged(pages(spark, [])).collect() == []
    rows = urls.judged(pages(spark, LINKS[:9]), rules=()).collect()
    assert all((r["rule"], r["verdict"], r["score"]) == (None, "allow", 0.0) for r in rows) and len(rows) == 9
    rows = urls.judged(pages(spark, ["http://freebets.example.net/"])).collect()  # its page has no text
    assert [r["verdict"] for r in rows] == ["block"]
