"""Quality classifier as a sparse ensemble of rules over text statistics.

Small trees are grown on labelled rows, each on a random half of them and fitted
to what the trees before it leave over.  Every path from a root becomes a rule, a
conjunction of comparisons.  A logistic model with a lasso penalty picks and
weighs the rules, and those that keep a weight are compiled into one Spark column
expression over the statistics.

Bound: trees and weights come from at most `sample` labelled rows, those of least
hashed id; statistics and scores cover every row's whole text.

Defined results: null and empty texts have all statistics 0 and get the score of
such a text; without labels of both kinds every score is the same.  Only doc_id
and text are read; labels with a null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, remainder, ship
from .op5_toxicity import labelled
from .textscan import pieces, text_bytes
from .textstats import Stats

SAMPLE, FOLDS, HELD = 6000, 3, 1


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: What rules may look at.
STATISTICS = {
    "log_words": lambda s: np.log1p(s.n_words),
    "word_length": lambda s: _share(s.word_chars, s.n_words),
    "symbols": lambda s: _share(s.n_symbols, s.n_words),
    "capitals": lambda s: _share(s.n_upper, s.n_letters),
    "digits": lambda s: _share(s.n_digits, s.word_chars),
    "exclamations": lambda s: _share(s.n_exclaim, s.n_words),
    "pipes": lambda s: _share(s.n_pipes, s.n_words),
    "punctuation": lambda s: _share(s.n_punct, s.word_chars),
    "odd_ends": lambda s: _share(s.n_odd_ends, s.n_words),
    "letter_words": lambda s: _share(s.n_alpha_words, s.n_words),
    "distinct": lambda s: _share(s.n_distinct, s.n_words),
    "repeated": lambda s: _share(s.n_repeat_words, s.n_words),
    "stutter": lambda s: _share(s.n_stutter, s.n_words),
    "twin_lines": lambda s: _share(s.n_dup_lines, s.n_lines),
    "line_words": lambda s: _share(s.n_words, s.n_lines),
}

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): above is value > bound


def statistics(docs: DataFrame, given: list[str]) -> DataFrame:
    """The given columns and every statistic of the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("_text"))
            for a, b in pieces(np.diff(at)):
                s = Stats(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                found = [pa.array(np.asarray(f(s), float)) for f in STATISTICS.values()]
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in given), *found], names=[*given, *STATISTICS])

    out = docs.select(*given, F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "_text"] + [f"{c} double" for c in STATISTICS])
    return out.mapInArrow(run, schema)


def _grow(x: np.ndarray, r: np.ndarray, rows: np.ndarray, path: Rule, depth: int, tried: np.ndarray, least: int, out: list[tuple[Rule, np.ndarray]]) -> np.ndarray:
    """Split to reduce the squared error of r; adds each node's path; gives the tree's values on all of its rows."""
    value = np.zeros(len(r))
    value[rows] = r[rows].mean()
    if path:
        out.append((path, rows))
    if depth == 0 or len(rows) < 2 * least:
        return value
    best = (1e-9, -1, 0.0)
    total, n = r[rows].sum(), len(rows)
    for j in tried:
        order = np.argsort(x[rows, j], kind="stable")
        v, c = x[rows, j][order], np.cumsum(r[rows][order])
        k = np.arange(least, n - least + 1)
        k = k[v[k - 1] < v[k]] if len(k) and k[-1] < n else k[:-1][v[k[:-1] - 1] < v[k[:-1]]]
        if len(k):
            gain = c[k - 1] ** 2 / k + (total - c[k - 1]) ** 2 / (n - k) - total**2 / n
            g = int(gain.argmax())
            if gain[g] > best[0]:
                best = (float(gain[g]), int(j), float((v[k[g] - 1] + v[k[g]]) / 2))
    if best[1] < 0:
        return value
    _, j, bound = best
    for above in (False, True):
        part = rows[(x[rows, j] > bound) == above]
        value[part] = _grow(x, r, part, (*path, (j, above, bound)), depth - 1, tried, least, out)[part]
    return value


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    rng, fitted, rules = np.random.default_rng(seed), np.zeros(len(y)), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        tried = np.sort(rng.choice(x.shape[1], 7, replace=False))
        out: list = []
        p = 1 / (1 + np.exp(-fitted))
        r = (y - p) / max(0.05, float((p * (1 - p)).mean()))
        _grow(x, r, rows, (), depth, tried, least, out)
        for path, part in out:
            rules.setdefault(path, None)
            if len(path) == depth:
                fitted[holds(x, path)] += rate * np.clip(r[part].mean(), -3, 3)
    return list(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, bound in rule:
        ok &= (x[:, j] > bound) == above
    return ok


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Proximal gradient steps with momentum; the intercept is free."""
    n, m = z.shape
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b, v, vb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ g / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE, penalty: float = 0.0007) -> tuple[float, list[tuple[Rule, float]]]:
    """The intercept, and the rules with a weight."""
    rows = statistics(labelled(docs, labels, "quality", folds, held, sample), ["y"]).collect()
    x = np.array([r[1:] for r in rows], float).reshape(-1, len(STATISTICS))
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return (4.0 if len(y) and y[0] else 0.0), []
    rules = extract_rules(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    z = np.stack([holds(x, r) for r in rules], 1).astype(float)
    _, one = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows: the first
    one = np.sort(one)
    z, rules = z[:, one], [rules[k] for k in one]
    b, w = lasso_logistic(z, y, penalty)
    return b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as one column expression over the statistics."""
    names = list(STATISTICS)
    total = F.lit(float(bias))
    for rule, weight in rules:
        tests = [(F.col(names[j]) > bound) if above else (F.col(names[j]) <= bound) for j, above, bound in rule]
        total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the statistics, score and predicted."""
    bias, rules = train(docs, labels, folds, held, sample)
    out = statistics(docs, ["doc_id"]).withColumn("score", compiled(bias, rules))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
