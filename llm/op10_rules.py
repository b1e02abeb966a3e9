"""Quality rules as a short-circuit cascade.

The base counts of the contract are made for every document.  Each rule is then
measured on a sample: what share of documents it rejects, and what it costs on top
of the counts that are there already.  Rules run in the order of rejections per cost,
each only over the documents that all earlier ones have passed: their bytes are
cut out, the counts known of them go along.  The verdict is the same in every order;
only the work differs.

Bound: rules are measured on at most `sample` rows; the verdict covers every row.

Defined results: null and blank texts have no words and fail the base test; an empty
table gives no rows; rules of equal worth run in the order of their names.  A long
text is counted whole, with some 100 bytes of memory for each of its bytes.
Repeated rows are judged each.  Only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ship
from .textscan import pieces, text_bytes
from .textstats import Stats

SAMPLE = 2000


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: Rules by name; each says which rows it rejects.
RULES: dict[str, Callable[[Stats], np.ndarray]] = {
    "word_length": lambda s: (_share(s.word_chars, s.n_words) < 2) | (_share(s.word_chars, s.n_words) > 14),
    "symbols": lambda s: _share(s.n_symbols, s.n_words) > 0.3,
    "capitals": lambda s: _share(s.n_upper, s.n_letters) > 0.6,
    "exclamation": lambda s: _share(s.n_exclaim, s.n_words) > 0.3,
    "no_letters": lambda s: _share(s.n_alpha_words, s.n_words) < 0.7,
    "digits": lambda s: _share(s.n_digits, s.word_chars) > 0.3,
    "lines": lambda s: (s.n_lines >= 4) & (_share(s.n_dup_lines, s.n_lines) > 0.5),
    "odd_words": lambda s: _share(s.n_odd_ends, s.n_words) > 0.4,
}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(raw: np.ndarray, at: np.ndarray) -> Stats:
    """Statistics with the base counts made."""
    s = Stats(raw, at)
    for name in BASE:
        getattr(s, name)
    return s


def cascade(s: Stats, rules: list[str], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Which rows pass all rules, by which rule (its index; -1: none) the others fell, and the bytes each rule looked at."""
    fell = np.full(len(alive), -1, np.int32)
    rows, work = np.flatnonzero(alive), []
    now = s.narrow(alive)
    for k, name in enumerate(rules):
        work.append(len(now.raw) if len(rows) else 0)
        if len(rows):
            out = RULES[name](now)
            fell[rows[out]] = k
            now, rows = now.narrow(~out), rows[~out]
    passed = np.zeros(len(alive), bool)
    passed[rows] = True
    return passed, fell, work


def measured(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Rules in the order of rejections per cost, from at most `sample` rows, those of ids of least hash."""
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").alias("chosen")).where("chosen is not null").orderBy(F.xxhash64("chosen"), "chosen").limit(sample).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("chosen"), "left_semi").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for a, b in pieces(np.diff(at)):
                n += b - a
                base = counted(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                for name, rule in RULES.items():
                    s = Stats(base.raw, base.at)
                    s.held = dict(base.held)
                    began = time.perf_counter()
                    hits[name] += int(rule(s).sum())
                    cost[name] += time.perf_counter() - began
        if n:
            yield pa.record_batch({"rule": list(RULES), "cost": [cost[r] for r in RULES], "hits": [hits[r] for r in RULES], "n": [n] * len(RULES)})

    found = some.mapInArrow(run, "rule string, cost double, hits long, n long").groupBy("rule").agg(F.sum("cost"), F.sum("hits"), F.sum("n")).collect()
    worth = {r: hits / n / max(cost / n, 1e-12) for r, cost, hits, n in found}
    return sorted(RULES, key=lambda r: (-worth.get(r, 0.0), r))


def quality_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rejected_by (the rule that a document fell by, or null)."""
    ship(docs.sparkSession)
    order = order or measured(docs)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for a, b in pieces(np.diff(at)):
                s = counted(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
                kept, fell, _ = cascade(s, order, ~failed)
                names = [order[k] if k >= 0 else None for k in fell.tolist()]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(np.asarray(getattr(s, c), np.int64)) for c in BASE), pa.array(failed), pa.array(kept), pa.array(names, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in BASE) + "base_failed boolean, kept boolean, rejected_by string")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).drop("rejected_by")


_COUNT = lambda of: f"len(regexp_replace(t, '[^{of}]', '', 'g'))"
#: Every count by regular expressions; the rules' bounds as above.
ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  cut AS (SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM texts)),
  grams AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, p, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) END AS g FROM cut WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE g IS NOT NULL),
  again AS (SELECT r, count(DISTINCT p + k) AS repeated FROM grams, range(0, 3) AS x(k) WHERE n > 1 GROUP BY r),
  lined AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS twins FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
  worded AS (SELECT r, count(*) AS n, sum(len(w)) AS chars, count(*) FILTER (regexp_matches(w, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')) AS alpha, count(*) FILTER (regexp_matches(w, '[#*$%&|<>!]$')) AS odd FROM cut GROUP BY r),
  counted AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(chars, 0)::BIGINT AS chars, {_COUNT('#*$%&|<>')} AS symbols, coalesce(twins, 0) AS twins, coalesce(repeated, 0) AS repeated, coalesce(n_lines, 0) AS n_lines, coalesce(alpha, 0) AS alpha, coalesce(odd, 0) AS odd,
    {_COUNT(r'A-Z\x{C0}-\x{DE}')} AS upper, {_COUNT(r'A-Za-z\x{80}-\x{10FFFF}')} AS letters, {_COUNT('0-9')} AS digits, {_COUNT('!')} AS exclaim
    FROM texts LEFT JOIN worded USING (r) LEFT JOIN again USING (r) LEFT JOIN lined USING (r)),
  shares AS (SELECT *, greatest(n, 1)::DOUBLE AS m, n < 50 OR 100 * repeated > 50 * n AS failed FROM counted)
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, twins AS n_dup_lines, repeated AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (chars / m < 2 OR chars / m > 14 OR symbols / m > 0.3 OR upper / greatest(letters, 1)::DOUBLE > 0.6 OR exclaim / m > 0.3 OR alpha / m < 0.7
    OR digits / greatest(chars, 1)::DOUBLE > 0.3 OR (n_lines >= 4 AND twins / greatest(n_lines, 1)::DOUBLE > 0.5) OR odd / m > 0.4) AS kept
FROM shares"""
