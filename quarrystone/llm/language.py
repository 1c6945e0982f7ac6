"""Language identification in two steps: the family first, then one-versus-one linear support vector machines
among the languages of that family.

A text's features are the square roots of the shares of its hashed letter trigrams (UTF-8 bytes, small letters,
everything else a blank).  Families are told apart by one linear machine each against the rest; a family's
languages by one machine a pair, whose votes decide (ties: the larger sum of margins, then the smaller name).
Margins become probabilities by a logistic curve fitted on the training rows.

Training rows are a sample bounded by `sample_rows`: of each language an equal share, chosen by a hash of the id.
Prediction reads whole texts and nothing but the text.

Defined cases: null text and texts without letters are `und` with score 0, as is everything if no row can be
learned from; a language without a known family is a family of its own; copies, and rows with one id, are predicted
each alike; an empty table gives an empty result; very long texts are read whole; other columns are ignored by
`identify` and kept by `known_language`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.base import arrow_filter, arrow_map, fold, spread

SAMPLE_ROWS = 6000
FEATURES = 2048
#: Language families by ISO 639-1 code.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca co es fr gl it la oc pt ro sc",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Uralic": "et fi hu se",
    "Turkic": "az kk ky tk tr tt ug uz",
    "Indic": "as bn gu hi mr ne or pa sd si ur",
    "Dravidian": "kn ml ta te",
    "Semitic": "am ar he mt",
    "Celtic": "br cy ga gd",
    "Baltic": "lt lv",
    "Malayo-Polynesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))  # letters by Unicode category, so no numerals like ½ or Ⅷ


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b"  " + text.lower().encode().translate(_LETTERS) + b"  ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    n = np.bincount((h >> np.uint32(21))[b[1:-1] != 32], minlength=FEATURES).astype(np.float32)
    return np.sqrt(n / max(1.0, n.sum()))


def linear_machine(x: np.ndarray, y: np.ndarray, c: float = 100.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, squared hinge loss, by accelerated
    gradient steps.  y: 1 and -1; both sides weigh alike."""
    n, sides = len(y), np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step = np.float32(1 / (1 / c + 4.0))
    for k in range(rounds if n else 0):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * sides
        grad = v / c
        grad[:-1] -= 2 * (slack @ x)
        grad[-1] = -2 * slack.sum()
        new = v - step * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def slope(margins: np.ndarray, right: np.ndarray) -> float:
    """a of 1 / (1 + exp(-a * margin)), by Newton steps, a little smoothed."""
    a = 2.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * margins, -30, 30)))
        a -= float(np.sum((p - np.clip(right, 0.01, 0.99)) * margins) / (np.sum(p * (1 - p) * margins**2) + 1e-6))
        a = min(max(a, 0.5), 20.0)
    return a


@dataclass
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]
    of_family: np.ndarray  # a row of weights for each family
    family_slope: float
    of_pair: dict[tuple[str, str], tuple[np.ndarray, float]]

    @classmethod
    def fitted(cls, x: np.ndarray, lang: np.ndarray) -> LanguageModel:
        family = np.array([FAMILY_OF.get(v, v) for v in lang], object)
        families = sorted(set(family))
        languages = {f: sorted(set(lang[family == f])) for f in families}
        side = lambda hit: np.where(hit, 1, -1).astype(np.float32)
        rows = [linear_machine(x, side(family == f)) for f in families] if len(families) > 1 else []
        weights = np.stack(rows) if rows else np.zeros((len(families), x.shape[1] + 1), np.float32)
        margins = x @ weights[:, :-1].T + weights[:, -1]
        a = slope(margins.ravel(), (family[:, None] == np.array(families, object)[None, :]).ravel().astype(float)) if rows else 1.0
        pairs = {}
        for f in families:
            for i, p in enumerate(languages[f]):
                for q in languages[f][i + 1 :]:
                    use = (lang == p) | (lang == q)
                    y = side(lang[use] == p)
                    w = linear_machine(x[use], y)
                    pairs[p, q] = w, slope(x[use] @ w[:-1] + w[-1], (y > 0).astype(float))
        return cls(families, languages, weights, a, pairs)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        squash = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        p = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            m = self.of_family[:, :-1] @ x + self.of_family[:, -1]
            family, p = self.families[int(np.argmax(m))], float(squash(self.family_slope * m.max()))
        names = self.languages[family]
        votes = {n: [0, 0.0, 1.0] for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w, k = self.of_pair[a, b]
                m = float(w[:-1] @ x + w[-1])
                for n, d in ((a, m), (b, -m)):
                    votes[n][0] += d > 0
                    votes[n][1] += d
                    votes[n][2] = min(votes[n][2], float(squash(k * d)))
        best = min(names, key=lambda n: (-votes[n][0], -votes[n][1], n))
        return best, p * votes[best][2]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a sample of at most about sample_rows rows of docs with text and lang."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != "und")).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    n = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = sample_rows / max(1, len(n))
    rate = F.create_map(*[v for k, m in n.items() for v in (F.lit(k), F.lit(share / m))]) if n else None
    rows = usable.where(spread("doc_id", "language") < rate[F.col("lang")]).select("lang", "text") if n else usable.select("lang", "text").limit(0)

    def make():
        def work(cols):
            kept = [(k, features(t).astype(np.float16).tobytes()) for k, t in zip(*cols, strict=True) if has_letter(t)]
            return [[k for k, _ in kept], [v for _, v in kept]]

        return work

    got = arrow_map(rows, make, ["lang", "text"], "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), FEATURES)
    return LanguageModel.fitted(x, np.array([r["lang"] for r in got], object))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of documents that may be learned from; the others are held out."""
    return docs.where(F.coalesce(fold(key) % 5 != 0, F.lit(False)))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def work(cols):
            found = [predict(features(t)) if has_letter(t) else ("und", 0.0) for t in cols[1]]
            return [cols[0], [f[0] for f in found], [f[1] for f in found]]

        return work

    return arrow_map(docs, make, [key, text], f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def known_language(docs: DataFrame, model: LanguageModel, least: float, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that are in a learned language with a score of least or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def work(cols):
            found = [predict(features(t)) if has_letter(t) else ("und", 0.0) for t in cols[0]]
            return [name != "und" and score >= least for name, score in found]

        return work

    return arrow_filter(docs, make, [text])
