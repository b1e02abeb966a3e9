"""Models that callers bring: extraction, embedding and text comparison.  None of them is needed."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: A model takes a prompt and returns JSON text; it raises if it can't.
Model = Callable[[str], str]


class TokenBucket:
    """At most `rate` calls a second with bursts of `burst`; lives in one worker."""

    def __init__(self, rate: float, burst: int, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.burst, self.held + (now - self.at) * self.rate)
        self.at = now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1


@dataclass
class Cascade:
    """Models in order; one that fails rests for a while, by what its error says."""

    models: dict[str, Model]
    bucket: TokenBucket | None = None
    clock: Callable[[], float] = time.monotonic
    resting: dict[str, float] = field(default_factory=dict)

    def rest(self, name: str, error: Exception) -> None:
        import re

        text = str(error).lower()
        said = re.search(r"retry[- ](?:after|in)\D{0,3}(\d+)", text)
        # Seconds of rest for an unknown model, an overloaded one, and any other failure.
        pause = float(said[1]) if said else 3600.0 if "404" in text else 60.0 if "503" in text else 300.0
        self.resting[name] = self.clock() + pause

    def __call__(self, prompt: str) -> tuple[str | None, str | None, int]:
        """Answer, the model that gave it, and attempts; None if all fail or rest."""
        tries = 0
        for name, model in self.models.items():
            if self.resting.get(name, 0.0) > self.clock():
                continue
            if self.bucket:
                self.bucket.take()
            tries += 1
            try:
                return model(prompt), name, tries
            except Exception as error:  # any failure of a model passes the prompt on
                self.rest(name, error)
        return None, None, tries


def extract(prompts: DataFrame, cascade: Callable[[], Cascade]) -> DataFrame:
    """doc_id, batch, answer, model_used, attempts; a prompt that no model answers yields a null answer, not an error."""
    ship(prompts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = cascade()
        for rows in batches:
            got = [ask(p) for p in rows["prompt"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "batch": rows["batch"], "answer": [g[0] for g in got], "model_used": [g[1] for g in got], "attempts": [g[2] for g in got]})

    return prompts.select("doc_id", "batch", "prompt").mapInPandas(run, "doc_id string, batch int, answer string, model_used string, attempts int")


def extraction_stats(answers: DataFrame) -> DataFrame:
    """Most attempts, and the first model that answered, of each document."""
    return answers.groupBy("doc_id").agg(F.max("attempts").alias("fallback_attempts"), F.min_by("model_used", F.when(F.col("model_used").isNotNull(), F.col("batch"))).alias("model_used"), F.sum(F.col("answer").isNull().cast("int")).alias("failed_batches"))


def embed(terms: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[list[float]]], size: int = 64) -> DataFrame:
    """term, vector: cached vectors, and the model's for the rest, asked in batches."""
    ship(terms.sparkSession)
    new = terms.select("term").distinct().join(cache, "term", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a in range(0, len(rows), size):
                part = list(rows["term"][a : a + size])
                yield pd.DataFrame({"term": part, "vector": model(part)})

    return cache.select("term", "vector").unionByName(new.mapInPandas(run, "term string, vector array<float>"))


def capabilities(scorer=None, model=None, parser=None) -> dict[str, bool]:
    """What is configured or importable here."""
    return {"extraction": model is not None, "text_scorer": scorer is not None, "parser": parser is not None, "pdf": importlib.util.find_spec("pypdf") is not None}
