"""A matcher learned from stewards' decisions, and an isolation forest for invoice amounts."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone import config
from quarrystone.operators.matching import latest
from quarrystone.sources.scratch import discard, on, written

TREES, TREE_ROWS = 100, 256
INTERCEPT = "(intercept)"
FEATURES = ["name_similarity", "tax_eq", "tax_conflict", "city_eq", "phone_eq", "domain_eq"]


def _digest(*keys: str) -> Column:
    """A hash that any engine has: of the keys' text."""
    return F.md5(F.concat_ws("|", *keys))


def training_set(pairs: DataFrame, decisions: DataFrame, per_class: int = config.AUTO_LABELS_PER_CLASS) -> DataFrame:
    """Features and label of decided pairs, and of at most per_class clear pairs of each kind: near-certain ones by
    the rules, picked by a hash, so the same at every layout."""
    told = latest(decisions.where("decision IN ('match', 'no_match')"), ["left_key", "right_key"], ["decided_at", "decision"])
    mine = pairs.join(told.select("left_key", "right_key", "decision"), ["left_key", "right_key"]).withColumn("label", (F.col("decision") == "match").cast("int")).withColumn("label_source", F.lit("steward"))
    rest = pairs.join(told.select("left_key", "right_key"), ["left_key", "right_key"], "left_anti")
    auto = rest.withColumn("label", F.when(F.col("tax_eq") & (F.col("name_similarity") >= 0.9), 1).when(F.col("tax_conflict") & (F.col("name_similarity") < 0.5), 0)).where("label IS NOT NULL")
    picked = auto.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(_digest("left_key", "right_key"), "left_key", "right_key"))).where(F.col("_n") <= per_class)
    cols = ["left_key", "right_key", *FEATURES, "label", "label_source"]
    return mine.select(cols).unionByName(picked.withColumn("label_source", F.lit("auto")).select(cols))


def newton(rows: DataFrame, features: list[str], penalty: float = 1.0, rounds: int = 50, close: float = 1e-10) -> np.ndarray:
    """Weights of the features and, last, the intercept of a logistic regression on rows (features, label, n): the
    summed loss plus penalty / 2 times the squared weights.  A round is one aggregation of the gradient and the
    Hessian, a few sums whatever the number of rows; a step that doesn't lower the loss is halved."""
    size = len(features) + 1
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    lasso = np.array([penalty] * (size - 1) + [0.0])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = reduce(lambda a, b: a + b, (F.lit(float(v)) * c for v, c in zip(w, x, strict=True)))
        sums = [F.sum(F.col("n") * (F.greatest(z, F.lit(0.0)) - F.col("label") * z + F.log1p(F.exp(-F.abs(z))))).alias("loss")]
        p = 1 / (1 + F.exp(-z))
        sums += [F.sum(F.col("n") * (p - F.col("label")) * x[i]).alias(f"g{i}") for i in range(size)]
        sums += [F.sum(F.col("n") * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)]
        r = rows.agg(*sums).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        return r["loss"] + float(lasso @ w**2) / 2, np.array([r[f"g{i}"] for i in range(size)]) + lasso * w, h + np.diag(lasso)

    w = np.zeros(size)
    loss, g, h = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(h + 1e-12 * np.eye(size), g)
        after = at(w - step)
        while after[0] > loss + 1e-12 * abs(loss) and np.abs(step).max() > close:
            step = step / 2
            after = at(w - step)
        w, (loss, g, h) = w - step, after
        if np.abs(step).max() <= close:
            break
    return w


def train_matcher(training: DataFrame) -> dict:
    """Logistic regression on three quarters of the pairs; precision, recall and coefficients on the rest.  Pairs with
    equal features are counted first: similarities have four decimals, so the rounds read a bounded table."""
    n = {(r["label_source"], r["label"]): r["n"] for r in training.groupBy("label_source", "label").agg(F.count("*").alias("n")).collect()}
    if sum(v for (s, _), v in n.items() if s == "steward") < config.MIN_STEWARD_LABELS:
        return {"trained": False, "reason": f"fewer than {config.MIN_STEWARD_LABELS} steward labels"}
    if len({label for _, label in n}) < 2:
        return {"trained": False, "reason": "one class only"}
    held = F.substring(_digest("left_key", "right_key"), 1, 1).isin("0", "4", "8", "c")
    rows = training.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], "label", held.alias("held"))
    rows = written(rows.groupBy(*FEATURES, "label", "held").agg(F.count("*").alias("n")), "training")
    w = newton(rows.where("NOT held"), FEATURES)
    score = reduce(lambda a, b: a + b, (F.lit(float(v)) * F.col(f) for v, f in zip(w, FEATURES, strict=False)), F.lit(float(w[-1])))
    said = rows.where("held").withColumn("said", (score > 0).cast("int"))
    count = lambda label, prediction: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("said") == prediction), F.col("n"))), F.lit(0))
    got = said.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn")).first()
    discard(rows)
    share = lambda a, b: round(a / (a + b), 4) if a + b else 1.0
    return {"trained": True, "precision": share(got["tp"], got["fp"]), "recall": share(got["tp"], got["fn"]), "coefficients": dict(zip(FEATURES, map(float, w), strict=False)), "intercept": float(w[-1]), "rows": sum(n.values())}


def match_probability(model: dict) -> Column:
    """Of a pair by a registered model (features, weights), as a Column."""
    parts = (F.lit(float(model["weights"][f])) * F.col(f).cast("double") for f in model["features"])
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(float(model["weights"][INTERCEPT])))))


def _expected(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(x: np.ndarray, tree: int, node: int, depth: int, limit: int):
    """An isolation tree: (feature, cut, left, right), or the number of rows of a leaf.  What would be drawn comes from
    the MD5 of tree:node, so the tree is the same wherever it is grown."""
    free = np.flatnonzero(x.min(axis=0) < x.max(axis=0)) if len(x) > 1 else []
    if depth >= limit or not len(free):
        return len(x)
    drawn = hashlib.md5(f"{tree}:{node}".encode()).hexdigest()
    f = free[int(drawn[8:16], 16) % len(free)]
    low, high = x[:, f].min(), x[:, f].max()
    cut = low + int(drawn[:8], 16) / 2**32 * (high - low)
    left = x[:, f] < cut
    return int(f), float(cut), _grow(x[left], tree, 2 * node, depth + 1, limit), _grow(x[~left], tree, 2 * node + 1, depth + 1, limit)


def _depth(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)), 0)]
    while todo:
        t, rows, d = todo.pop()
        if isinstance(t, int):
            out[rows] = d + _expected(t)
        else:
            low = x[rows, t[0]] < t[1]
            todo += [(t[2], rows[low], d + 1), (t[3], rows[~low], d + 1)]
    return out


def isolation_scores(df: DataFrame, features: list[str], keys: list[str], trees: int = TREES, sample: int = TREE_ROWS, contamination: float = 0.02) -> DataFrame:
    """keys, outlier_score (six decimals), is_outlier.  The trees * sample rows whose keys' MD5 sums are smallest are dealt
    to the trees, sample after sample and from the start again, which grow on the driver from this bounded sample and go to the tasks, where all rows
    are scored in Arrow batches.  Outliers are above the exact quantile of the scores, of which there are at most
    a million different ones.  Nulls count as 0."""
    clean = df.select(*keys, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = clean.orderBy(_digest(*keys), *keys, *features).select(features).limit(trees * sample).collect()
    x = np.array([tuple(r) for r in rows], float).reshape(-1, len(features))
    size = min(sample, len(x))  # of each tree; those of a small table overlap
    limit = max(1, math.ceil(math.log2(max(2, size))))
    forest = [_grow(x[(t * sample + np.arange(size)) % len(x)], t, 1, 0, limit) for t in range(trees if size else 0)]
    shared, norm = df.sparkSession.sparkContext.broadcast(forest), max(1e-9, _expected(size))

    def run(batches):
        for pdf in batches:
            v = pdf[features].to_numpy(float)
            depth = np.mean([_depth(t, v) for t in shared.value], axis=0) if shared.value else np.zeros(len(v))
            yield pd.concat([pdf[keys], pd.Series(2.0 ** (-depth / norm), pdf.index, name="outlier_score")], axis=1)

    kinds = dict(df.dtypes)
    scored = clean.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", outlier_score double").withColumn("outlier_score", F.round("outlier_score", 6))
    scored = written(scored, "scored")  # the quantile and the rows read it
    cut = scored.agg(F.percentile("outlier_score", F.lit(1 - contamination))).first()[0]
    return on(scored.withColumn("is_outlier", F.col("outlier_score") > F.lit(cut)), scored)
