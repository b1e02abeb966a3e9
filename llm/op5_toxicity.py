"""Toxicity: Levenshtein automata over a lexicon trie, and scores of each hit's context.

The lexicon is learnt from labelled rows: words, or beginnings of words, that
stand in toxic documents and hardly ever in others.  An occurrence counts by its
neighbours, so that copies of one document count once.  Words of every document
then run through the lexicon's edit automaton, which also catches misspelled
terms.  A hit inside quotation marks, or close after a word of reporting or teaching,
is quoted rather than meant; what it counts against one that is meant is fitted on
the labelled rows, as are what misspelled hits of each term count and the logistic
model over the sums, which gives the score.

Bounds: the lexicon and the model come from at most `sample` labelled ids, those
of least hash, and one row of each; scoring covers every row.  Beginnings are learnt
up to BEGINNING letters, whole words of any length.

Defined results: null and empty texts have no hits and get the score of none;
without usable labels the lexicon is empty and nothing is toxic; an empty table gives
no rows.  Of equally near terms a word counts for the first by letters.  A long text
is read whole, by one task.  Only doc_id and text are read, so other columns may have
any name; labels with a null are left out, and a row labelled twice counts as toxic
if either label says so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, remainder, ship
from .levenshtein import Lexicon

SAMPLE, FOLDS = 8000, 5
#: A term needs so many different contexts in toxic documents, and at most this share of its contexts elsewhere.
LEAST, ELSEWHERE = 6, 0.03
QUOTES = "\"'“”„«»‘’`"
#: Words that mark a mention rather than a use, in the four languages of the corpus.
REPORTING = frozenset("said says called quote quoted quotes word words term terms wrote means meaning slur sagte genannt wort begriff zitat dit mot terme citation dijo palabra término cita".split())
EDGE = ".,;:!?()[]{}<>|*&%$#~…-—_/\\" + QUOTES
#: What a quoted hit may count against one that is meant; without evidence, the first.
QUOTED = (0.3, 0.0, 0.1, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
BEGINNING = 64


def bare(token: str) -> str:
    return token.strip(EDGE).lower()


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """doc_id, text and y of at most `sample` labelled ids outside the fold that is held out; of rows that share an id, one."""
    fold = remainder(F.col("doc_id"), folds) != held
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & fold).groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col(label)).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("of"), "of").limit(sample)
    # At most `sample` rows of 12 bytes: a proven bound.
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("of")).select("doc_id", "text", "y")
    text = F.coalesce("text", F.lit(""))
    return found.groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text")).select("doc_id", "text", "y")


def learn_lexicon(rows: DataFrame, least: int = LEAST, elsewhere: float = ELSEWHERE) -> list[tuple[str, bool]]:
    """Terms and whether each is a stem."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found: set = set()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                tokens = (text or "").split()
                for k, t in enumerate(tokens):
                    w = bare(t)
                    if len(w) > 2 and w.isalnum() and not w.isdigit():
                        near = f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}"
                        found.add((w, xxhash.xxh64_intdigest(near) >> 1, y))
            if found:
                w, c, y = zip(*found, strict=True)
                yield pa.record_batch({"w": w, "c": pa.array(c, pa.int64()), "y": pa.array(y, pa.int32())})

    once = rows.mapInArrow(contexts, "w string, c long, y int").distinct()
    tokens = once.groupBy("w").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    long = F.array_union(F.sequence(F.lit(3), F.least(F.length("w"), F.lit(BEGINNING))), F.array(F.length("w")))
    heads = tokens.select(F.explode(long).alias("k"), "w", "yes", "no").select(F.substring("w", F.lit(1), F.col("k")).alias("head"), F.when(F.length("w") == F.col("k"), F.col("yes")).otherwise(0).alias("own"), "yes", "no")
    heads = heads.groupBy("head").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("own").alias("own"))
    # Rows with `least` contexts of the sample or more, at most as many for each as a word has beginnings.
    pure = {h: (yes, own) for h, yes, no, own in heads.where((F.col("yes") >= least) & (F.col("no") <= elsewhere * (F.col("yes") + F.col("no")))).collect()}
    longer: dict[str, list[str]] = {}
    for h in pure:
        longer.setdefault(h[:-1], []).append(h)
    terms: dict[str, bool] = {}
    for head in sorted(pure, key=lambda h: (len(h), h)):
        if head[:-1] in pure or any(head[:k] in terms for k in range(3, len(head) + 1)):
            continue
        while more := max((h for h in longer.get(head, ()) if pure[h][0] >= 0.9 * pure[head][0]), key=lambda h: (pure[h], h), default=None):
            head = more
        terms[head] = pure[head][1] < 0.9 * pure[head][0]
    return list(terms.items())


class Scorer:
    """Hits of one process; distinct tokens are looked up once, in a memory of bounded size."""

    def __init__(self, terms: list[tuple[str, bool]], memory: int = 200_000):
        self.lexicon, self.known, self.memory = Lexicon(terms), {}, memory

    def look_up(self, token: str) -> tuple[int, str] | None:
        if len(self.known) >= self.memory:
            self.known.clear()
        hit = self.known[token] = self.lexicon.match(bare(token))
        return hit

    def hits(self, text: str) -> tuple[list[float], dict[str, list[float]], list[str]]:
        """How often exact terms are meant and quoted, the same of misspelled ones by term, and the terms."""
        tokens = text.split()
        known, look_up = self.known, self.look_up
        none = 0
        found = []
        for k, t in enumerate(tokens):
            hit = known.get(t, none)
            if hit is none:
                hit = look_up(t)
            if hit is not None:
                found.append((k, hit))
        exact, wrong = [0.0, 0.0], {}
        for k, (errors, term) in found:
            (wrong.setdefault(term, [0.0, 0.0]) if errors else exact)[self.quoted(tokens, k)] += 1
        return exact, wrong, sorted({term for _, (_, term) in found})

    @staticmethod
    def quoted(tokens: list[str], k: int, reach: int = 4) -> bool:
        """Whether the hit stands inside quotation marks or soon after a reporting word."""
        before, after = tokens[max(0, k - reach) : k], tokens[k + 1 : k + 1 + reach]
        opens = tokens[k][0] in QUOTES or any(t[0] in QUOTES and t[-1] not in QUOTES for t in before)
        closes = tokens[k].rstrip(".,;:!?")[-1:] in QUOTES or any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
        return (opens and closes) or any(bare(t) in REPORTING for t in before)


def trust(exact: list[list[float]], wrong: list[dict], y: list[float]) -> dict[str, float]:
    """What a term's misspelled hits count against exact ones: the share of toxic rows among those that have them
    and no exact hit, with four rows of a share of 0.8 added.  A term that clean words come close to counts little."""
    rows, toxic = Counter(), Counter()
    for e, w, label in zip(exact, wrong, y, strict=True):
        if not any(e):
            rows.update(w.keys())
            if label:
                toxic.update(w.keys())
    return {term: (toxic[term] + 3.2) / (n + 4) for term, n in rows.items()}


def total(exact: list[float], wrong: dict[str, list[float]], rho: dict[str, float], quoted: float) -> float:
    return exact[0] + quoted * exact[1] + sum((w[0] + quoted * w[1]) * rho.get(term, 0.8) for term, w in wrong.items())


def saturated(hits):
    return 1 - np.exp(-1.5 * hits)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(exact: list[list[float]], wrong: list[dict], y: list[float]) -> tuple[float, float, dict[str, float], float]:
    """Bias and weight, what misspelled hits of each term count, and what quoted ones do: the likeliest of QUOTED."""
    rho, best = trust(exact, wrong, y), None
    for quoted in QUOTED:
        hits = np.array([total(e, w, rho, quoted) for e, w in zip(exact, wrong, strict=True)])
        x = np.stack([np.ones(len(y)), saturated(hits)], 1)
        w = fit_logistic(x, np.array(y))
        w[1] = max(0.0, w[1])  # a hit is never a sign of a clean text
        p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-12, 1 - 1e-12)
        likely = float(np.sum(np.where(np.array(y) > 0, np.log(p), np.log(1 - p))))
        if best is None or likely > best[0] + 1e-6:
            best = (likely, (float(w[0]), float(w[1]), rho, quoted))
    return best[1]


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = 0, sample: int = SAMPLE) -> tuple[list[tuple[str, bool]], tuple]:
    """The lexicon and the model: bias, weight, what misspelled hits of each term count, what quoted ones do."""
    ship(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", folds, held, sample)
    terms = learn_lexicon(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        pairs = pa.list_(pa.float64())
        for batch in batches:
            got = [scorer.hits(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([g[0] for g in got], pairs), pa.array([list(g[1].items()) for g in got], pa.map_(pa.string(), pairs)), batch.column("y")], names=["e", "m", "y"])

    # At most `sample` rows, each with at most two numbers for each term.
    found = rows.mapInArrow(count, "e array<double>, m map<string,array<double>>, y int").collect()
    exact, wrong, y = [r[0] for r in found], [r[1] for r in found], [float(r[2]) for r in found]
    if not terms or len(set(y)) < 2:
        return [], (-4.0, 8.0, {}, QUOTED[0])
    return terms, fitted(exact, wrong, y)


def _scores(texts: pa.Array, scorer: Scorer, model: tuple) -> tuple[np.ndarray, list[list[str]]]:
    bias, weight, rho, quoted = model
    got = [scorer.hits(t or "") for t in texts.to_pylist()]
    hits = np.array([total(e, m, rho, quoted) for e, m, _ in got], float)
    return 1 / (1 + np.exp(-(bias + weight * saturated(hits)))), [g[2] for g in got]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted and the terms found, for each document."""
    terms, model = train(docs, labels, folds, held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                score, found = _scores(batch.column(1), scorer, model)
                yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "terms"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, terms array<string>")


def not_toxic(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is under 0.5, with all of their columns."""
    terms, model = train(docs, labels, folds, held, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                yield batch.filter(pa.array(_scores(batch.column(at), scorer, model)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
