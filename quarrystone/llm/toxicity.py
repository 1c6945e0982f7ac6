"""Toxicity of texts that may be disguised: a noisy channel is decoded first, then the restored text is scored.

Channel: a writer replaces letters by look-alikes (1d10t, also of other scripts, full width or with accents), repeats
them (idiooot), puts signs or blanks of any kind and number between them (i.d.i.o.t, i  d  i  o  t), or cuts a word in
two (idi ot).  A token with such traces becomes a lattice: each run of a character may stand for one or two of it, for
the letters it looks like, or for nothing, at a channel cost.  Viterbi decoding finds the cheapest reading under a
character trigram model, whose counts come from all documents, to which the words that turn out to be toxic are
added.  Tokens without traces have one reading and are taken as they are.  When a text is scored, doubled letters are
traces too, the parts of a token between signs are looked up as well, and a trie of the weighted words runs through
the lattice: a weighted word is read if WORD and its channel cost are no more than the cheapest path of letters costs.
Single characters in a row are searched for words from any of them on, letters with at most CHANNEL_SHARE for each.

Score: words are weighted by how much oftener they follow a different word in toxic than in other training texts.
(Counting the words before them, not texts, keeps the words of one much copied text from looking toxic.)  Words
below a significance level have no weight, nor have words that aren't toxic in either half of the texts by itself.
Words that are rare by themselves may share a stem: beginnings of STEM_LETTERS letters and more that at least STEM_FORMS
different letters follow are weighted in the same way, by the sums of their words.  A text's weights are summed over
its distinct restored words, each by itself or else by its longest weighted stem.  As chance forms of stems come with
length, a logistic curve fitted on the training rows turns the sum, and the text's length as far as stems matter, into a
score.

Training rows are a sample bounded by `sample_rows`; labels, ids and sources are no inputs of a score.

Defined cases: null and empty texts get the score of a text without weighted words; rows without a label are only
scored; without toxic or other training rows all scores are the share of toxic ones (0 if there are none); a
document labelled twice counts with its larger label; repeated rows are scored each; very long texts are read whole,
in time linear in them; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_map, discard, fold, spread, written

SAMPLE_ROWS = 12_000
#: 2 ln of the likelihood ratio that a weighted word needs; the sample bounds how many reach it.
SIGNIFICANCE, HALF_SIGNIFICANCE = 30.0, 10.0
STEM_LETTERS, STEM_FORMS = range(5, 13), 6
TOXIC_FROM = 0.7
#: The letters that digits and signs look like.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = set(".-_*~'^,/\\")
SUBSTITUTE, DROP_LOOKALIKE, DROP_SEPARATOR, DOUBLE = 1.0, 4.0, 0.3, 0.7
#: Costs of a weighted word as such, and of a blank inside; channel costs for each letter of a word among single characters.
WORD, CUT, CHANNEL_SHARE = 6.0, 3.0, 0.5
#: Small letters of other scripts that look like Latin ones.
OTHER_SCRIPTS = str.maketrans("авеікмнорстухѕјһԁԛԝαβεικνορτυχ", "abeikmhopctyxsjhdqwabeikvoptux")
#: The ASCII signs that look like no letter.
MUTE = "\"#%&')*,-./:;<=>?[\\]^_`{}~"
TOKENS_KEPT = 200_000
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
N_CLASSES = 28


def trigram_counts(text: str) -> np.ndarray:
    """Counts of character-class trigrams: blank or sign, a to z, other letters (by UTF-8 bytes)."""
    c = _CLASS[np.frombuffer(b" " + text.encode().translate(_LOWER) + b" ", np.uint8)].astype(np.int32)
    return np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_CLASSES**3)


def corpus_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all documents; each task sends its non-zero sums."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(N_CLASSES**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if v := t.as_py():
                    total += trigram_counts(v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N_CLASSES**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


@dataclass
class Decoder:
    """Viterbi decoding of tokens under a character trigram model."""

    counts: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        n = self.counts.reshape((N_CLASSES,) * 3).astype(float).copy()
        share = max(1.0, n.sum()) * 0.02 / max(1, len(self.lexicon))
        for w in self.lexicon:
            n += share * trigram_counts(w).reshape(n.shape) / (len(w.encode()) + 1)
        two = n.sum(axis=0)
        one = two.sum(axis=0) + 1
        p1 = one / one.sum()
        p2 = (two + 50 * p1) / (two.sum(axis=1, keepdims=True) + 50)
        p3 = (n + 20 * p2[None]) / (n.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(p3)

    @staticmethod
    def runs(token: str) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        for ch in token:
            if out and out[-1][0] == ch:
                out[-1] = (ch, out[-1][1] + 1)
            else:
                out.append((ch, 1))
        return out

    @staticmethod
    def readings(ch: str, n: int) -> list[tuple[str, float]]:
        """What a run of n equal characters may stand for, with channel costs."""
        if ch in SEPARATORS or _FOREIGN.match(ch):
            return [("", DROP_SEPARATOR)]
        if looks := LOOKS_LIKE.get(ch):
            return [(x * k, SUBSTITUTE + DOUBLE * abs(k - min(n, 2))) for x in looks for k in (1, 2) if k <= n] + [("", DROP_LOOKALIKE)]
        return [(ch * k, DOUBLE * abs(k - min(n, 2)) if n < 3 else 0.0) for k in (1, 2) if k <= n]

    def decode(self, token: str) -> str:
        """The cheapest reading of a small-letter token."""
        return self.read(token)[1]

    def read(self, token: str) -> tuple[float, str]:
        """Cost and text of the cheapest reading."""
        cls = lambda ch: ord(ch) - 96 if "a" <= ch <= "z" else 27
        # What was said so far is a chain of pieces, so the time is linear in the token; ties go by the text.
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for ch, n in self.runs(token):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, said) in best.items():
                for letters, extra in self.readings(ch, n):
                    c, x, y = cost + extra, a, b
                    for letter in letters:
                        z = cls(letter)
                        c += self.cost[x, y, z]
                        x, y = y, z
                    old, then = new.get((x, y)), (said, letters) if letters else said
                    if old is None or c < old[0] or c == old[0] and _joined(then) < _joined(old[1]):
                        new[x, y] = (c, then)
            best = new
        least = min(cost + self.cost[a, b, 0] for (a, b), (cost, _) in best.items())
        return least, min(_joined(said) for (a, b), (cost, said) in best.items() if cost + self.cost[a, b, 0] == least)

    def plain_cost(self, token: str) -> float:
        """Of a token taken as it is."""
        c, x, y = 0.0, 0, 0
        for ch in token:
            z = ord(ch) - 96 if "a" <= ch <= "z" else 27
            c, x, y = c + self.cost[x, y, z], y, z
        return c + self.cost[x, y, 0]

    def restore(self, token: str) -> str:
        """The word that a small-letter token between blanks stands for; "" for none."""
        bare = _OUTER.sub("", token)
        if bare.isalpha() and not _THRICE.search(bare):
            return bare
        core = token.strip("\"#%&?:;[]{}<>=,.")
        return self.decode(core) if any(c.isalpha() for c in core) else bare

    def every(self, token: str) -> set[str]:
        """What a small-letter token between blanks may say: the token, its parts between signs, and readings of both."""
        found = {self.restore(token)}
        for part in {_OUTER.sub("", token), *_PARTS.split(token)}:
            if any(map(str.isalpha, part)):
                found.add(self.restore(part))
                if _TWICE.search(part) or not part.isalpha():
                    found.add(self.decode(part))
        if not token.isalpha():
            found.update(_LETTERS.findall(token))
        return found

    def spaced(self, text: str) -> list[str]:
        """Readings of four or more single characters in a row, of any length; other signs part them."""
        return [self.decode(x) for run in single_characters(text) for x in _FOREIGN.split(run) if any(map(str.isalpha, x))]


def single_characters(text: str) -> list[str]:
    """Four or more single characters in a row, without what is between them."""
    return ["".join(m[0].split()) for m in _SPACED.finditer(text)]


def folded(token: str) -> str:
    """A small-letter token in Latin letters without accents, as far as its letters look like some."""
    if token.isascii():
        return token
    apart = unicodedata.normalize("NFKD", token)
    return "".join(ch for ch in apart if not unicodedata.combining(ch)).lower().translate(OTHER_SCRIPTS)


def _joined(said: tuple) -> str:
    out = []
    while said:
        said, letters = said
        out.append(letters)
    return "".join(reversed(out))


#: Signs that are neither letters nor look-alikes nor separators, with digits that look like none.
_FOREIGN = re.compile(rf"(?:(?![{re.escape(''.join(LOOKS_LIKE) + ''.join(sorted(SEPARATORS)))}])[\W\d_])+")
#: Signs that aren't look-alikes part a token.
_PARTS = re.compile(rf"(?:(?![{re.escape(''.join(LOOKS_LIKE))}])[\W_])+")
_OUTER = re.compile(r"^[\W_]++|(?<![\W_])[\W_]++$")
_LETTERS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1")
_REPEATS = re.compile(r"(.)\1+")
_THRICE = re.compile(r"(.)\1\1")
#: Four or more single characters with a sign between each two.
_SPELLED = re.compile(r"[^\W_](?:[\W_]+[^\W_]){3,}(?![^\W_])")


def restored_words(text: str, decoder: Decoder, cache: dict[str, str]) -> list[str]:
    """The words of a text, restored, in order; spelled-out words last."""
    small, out = text.lower(), []
    for token in small.split():
        if (w := cache.get(token)) is None:
            if len(cache) >= TOKENS_KEPT:
                cache.clear()
            w = cache[token] = decoder.restore(token)
        out.append(w)
    return out + decoder.spaced(small)


_HITS: tuple[dict[str, float], dict[str, tuple[str, ...]]] = ({}, {})


def hits_of(weights: dict[str, float]) -> dict[str, tuple[str, ...]]:
    """The weighted words of tokens seen in this process: one store, which goes when other weights come."""
    global _HITS
    if _HITS[0] is not weights:
        _HITS = (weights, _HITS[1] if _HITS[0] == weights else {})
    return _HITS[1]


@dataclass
class ToxicityModel:
    decoder: Decoder
    weights: dict[str, float]
    slope: float
    base: float
    stems: dict[str, float] = field(default_factory=dict)
    tilt: float = 0.0  # for the logarithm of the number of words, see features

    def __post_init__(self):
        self.stem_sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.inside = re.compile("|".join(sorted((re.escape(w) for w in self.weights if len(w) >= 4), key=lambda w: (-len(w), w))) or r"(?!)")
        self.shapes = {_REPEATS.sub(r"\1", w) for w in self.weights}
        self.heads = {w[:k] for w in self.weights for k in range(2, len(w) - 1)}
        self.trie: dict = {}
        for w in self.weights:
            node = self.trie
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def words_of(self, token: str) -> tuple[str, ...]:
        """The weighted words of a small-letter token.  Mute signs around it say nothing.  Letters
        are never dropped or exchanged, only repeated, so a token of letters can only say words of its own shape."""
        token = token.strip(MUTE)
        if token in self.weights:
            return (token,)
        found = self._said(token)
        found.update(w for w in {token, *_LETTERS.findall(token)} if w not in self.weights and self.by_stem(w))
        if not token.isascii() and (plain := folded(token)) != token:
            found |= self._said(plain.strip(MUTE))
        return tuple(sorted(found))

    def by_stem(self, word: str) -> float:
        """The weight of the longest stem of a word of letters; 0 if there is none."""
        for k in self.stem_sizes:
            if len(word) > k and word[:k] in self.stems and word.isalpha():
                return self.stems[word[:k]]
        return 0.0

    def _said(self, token: str) -> set[str]:
        if token.isalpha() and _REPEATS.sub(r"\1", token) not in self.shapes:
            return set()
        found = {w for w in self.decoder.every(token) if w in self.weights}
        if any(map(str.isalpha, token)):
            ways = self._along(token, False)
            if ways:
                most = self.decoder.read(token)[0]
                found.update(w for w, cost in ways.items() if WORD + cost <= most)
            for m in _SPELLED.finditer(token):  # letter by letter, perhaps several words
                found.update(self._spotted(m[0]))
        return found

    def _along(self, token: str, anywhere: bool) -> dict[str, float]:
        """The weighted words that a path of the token's lattice spells, with the least channel cost; all of the
        token, or any part of it."""
        found: dict[str, float] = {}
        states: list[tuple[dict, float]] = [(self.trie, 0.0)]
        for ch, n in self.decoder.runs(token):
            best: dict[int, tuple[dict, float]] = {}
            for letters, extra in self.decoder.readings(ch, n):
                for node, cost in states:
                    for letter in letters:
                        node = node.get(letter)
                        if node is None:
                            break
                    if node is not None and (id(node) not in best or cost + extra < best[id(node)][1]):
                        best[id(node)] = (node, cost + extra)
            states = list(best.values())
            if anywhere:
                for node, cost in states:
                    if "" in node and cost < found.get(node[""], math.inf):
                        found[node[""]] = cost
                states = [(node, cost) for node, cost in states if node is not self.trie] + [(self.trie, 0.0)]
            if not states:
                return {}
        if not anywhere:
            for node, cost in states:
                if "" in node:
                    found[node[""]] = cost
        return found

    def _spotted(self, run: str) -> set[str]:
        """The weighted words among characters that stand one by one."""
        said = set(self.inside.findall(self.decoder.decode(run))) if run else set()
        return said | {w for w, cost in self._along(run, True).items() if len(w) >= 4 and cost <= CHANNEL_SHARE * len(w)}

    def _cut(self, tokens: list[str]) -> set[str]:
        """The weighted words that a blank has cut in two, where that costs less than two words of their own."""
        found = set()
        for at, head in enumerate(tokens[:-1]):
            if head in self.heads and (w := head + (tail := tokens[at + 1].strip(MUTE))) in self.weights and tail:
                if WORD + CUT <= self.decoder.plain_cost(head) + self.decoder.plain_cost(tail):
                    found.add(w)
        return found

    def evidence(self, text: str) -> float:
        """The sum of the weights of the distinct weighted words of the restored text."""
        return self.features(text)[0]

    def features(self, text: str | None) -> tuple[float, float]:
        """The evidence, and the logarithm of the number of words times the share of the evidence that words with a
        weighted stem give: only such words come by chance."""
        small, found, hits = (text or "").lower(), set(), hits_of(self.weights)
        tokens = small.split()
        for token in set(tokens):
            if (ws := hits.get(token)) is None:
                if len(hits) >= TOKENS_KEPT:
                    hits.clear()
                ws = hits[token] = self.words_of(token)
            found.update(ws)
        found |= self._cut(tokens)
        for run in single_characters(small):
            for x in {run, folded(run)}:
                for part in _FOREIGN.split(x):
                    if any(map(str.isalpha, part)):
                        found |= self._spotted(part) | self._said(part)
        each = {w: self.weights.get(w) or self.by_stem(w) for w in sorted(found)}
        total, by_chance = sum(each.values()), sum(v for w, v in each.items() if self.by_stem(w))
        return total, math.log1p(len(tokens)) * by_chance / total if total else 0.0

    def score(self, text: str | None) -> float:
        told, length = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * told + self.tilt * length + self.base))))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """slope, tilt and base of a weighted logistic regression on two features, a little smoothed, by Newton steps.  More
    evidence never lowers a score, and length never raises one."""
    free = [True, True]
    while True:
        z = np.c_[x * free, np.ones(len(x))]
        w, toward, strong = np.array([1.0, 0.0, -2.0]) * [*free, True], np.array([1.0, 0.0, 0.0]) * [*free, True], np.array([0.1, 0.1, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (weight * (p - y)) + strong * (w - toward)
            w = w - np.clip(np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(strong), g), -2, 2)
        if w[0] < 0 and free[0]:
            free[0] = False
        elif w[1] > 0 and free[1]:
            free[1] = False
        else:
            return max(float(w[0]), 0.0), min(float(w[1]), 0.0), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """labels: key, toxic.  At most about sample_rows of them are used, toxic and other ones in equal parts."""
    labels = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    decoder = Decoder(corpus_counts(docs, text))
    total = sum(n.values())
    rate = n.get(1, 0) / total if total else 0.0
    if not rate or rate == 1:
        return ToxicityModel(decoder, {}, 0.0, math.log((rate + 1e-9) / (1 - rate + 1e-9)))
    chosen = labels.where(spread(key, "toxicity") < F.when(F.col("toxic") == 1, sample_rows / 2 / n[1]).otherwise(sample_rows / 2 / n[0]))
    # chosen has at most about sample_rows rows of two numbers: that bounds the broadcast.
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(decoder)

    def follow():
        cache: dict[str, str] = {}

        def work(cols):
            out = [[], [], [], []]
            for t, y in zip(*cols, strict=True):
                ws = [w for w in restored_words(t or "", shared.value, cache) if w]
                half = 1 + zlib.crc32((t or "").encode()) % 2
                for w, before in {(w, b) for b, w in zip(["", *ws], ws, strict=False) if len(w) >= 3}:
                    for column, v in zip(out, (w, before, y, half), strict=True):
                        column.append(v)
            return out

        return work

    pairs = arrow_map(rows, follow, [text, "toxic"], "word string, before string, toxic int, half int")
    pairs = pairs.groupBy("word", "before", "toxic").agg(F.bit_or("half").alias("halves"))
    count = lambda toxic, half: F.sum(((F.col("toxic") == toxic) & (F.col("halves").bitwiseAND(half) > 0)).cast("long"))
    words = written(pairs.groupBy("word").agg(*(count(y, half).alias(f"{name}{half}") for y, name in ((1, "t"), (0, "c")) for half in (1, 2, 3))), "words")
    sums = words.agg(*(F.sum(f"{name}{half}").alias(f"{name}{half}") for name in "tc" for half in (1, 2, 3))).first()
    log = lambda x: F.ln(F.greatest(x, F.lit(1e-12)))

    def toxic_in(half: int, significance: float) -> tuple[Column, Column, Column]:
        """Whether a word is toxic in a half of the texts (3: in all), its weight and its likelihood ratio there."""
        all_t, all_c = float(sums[f"t{half}"] or 1), float(sums[f"c{half}"] or 1)
        p, t, c = all_t / (all_t + all_c), F.col(f"t{half}"), F.col(f"c{half}")
        m = t + c
        of_t = t / F.greatest(m, F.lit(1))
        ratio = 2 * m * (of_t * (log(of_t) - math.log(p)) + (1 - of_t) * (log(1 - of_t) - math.log(1 - p)))
        weight = log((t + 0.5) / all_t * all_c / (c + 0.5))
        return (of_t > p) & (ratio >= significance) & (weight > math.log(4)), weight, ratio

    holds, weight, ratio = toxic_in(3, SIGNIFICANCE)
    for half in (1, 2):
        holds = holds & toxic_in(half, HALF_SIGNIFICANCE)[0]
    weights = {r["word"]: float(r["w"]) for r in words.where(holds).select("word", weight.alias("w")).orderBy("word").collect()}
    # Beginnings of words: what follows is one letter at least.
    cuts = F.filter(F.array(*map(F.lit, STEM_LETTERS)), lambda k: k < F.char_length("word"))
    letters = words.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("k", F.explode(cuts))
    sums_of = [F.sum(f"{name}{half}").alias(f"{name}{half}") for name in "tc" for half in (1, 2, 3)]
    forms = F.count_distinct(F.when(F.col("t3") > 0, F.substring("word", F.col("k") + 1, 1)))
    stems = letters.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("stem")).agg(*sums_of, forms.alias("forms"))
    known = {r["stem"]: float(r["w"]) for r in stems.where(holds & (F.col("forms") >= STEM_FORMS)).select("stem", weight.alias("w")).orderBy("stem").collect()}
    discard(words)
    model = ToxicityModel(Decoder(decoder.counts, weights), weights, 1.0, 0.0, known)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh():
        return lambda cols: [*map(list, zip(*map(sent.value.features, cols[0]), strict=True)), cols[1]]

    got = arrow_map(rows, weigh, [text, "toxic"], "x double, length double, toxic int").collect()
    x, y = np.array([(r["x"], r["length"]) for r in got]).reshape(-1, 2), np.array([r["toxic"] for r in got], float)
    share = np.where(y > 0, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum())) if len(y) else y
    model.slope, model.tilt, model.base = _curve(x, y, share * len(y) / max(1, total))
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score, predicted (1 from TOXIC_FROM on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(cols):
            found = [m.score(t) for t in cols[1]]
            return [cols[0], found, [int(s >= TOXIC_FROM) for s in found]]

        return work

    return arrow_map(docs, make, [key, text], f"{key} {dict(docs.dtypes)[key]}, score double, predicted int")


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that may be learned from; the others are held out."""
    return labels.where(F.coalesce(fold(key) % 3 != 1, F.lit(False)))
