"""Readers of page files, facts in JSON, and the ledger's CSV."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import file_id
from ..runtime import ship

#: A parser takes a file's path and bytes and yields (page number, text, blocks, tables as (headers, rows)).
Parser = Callable[[str, bytes], Iterator[tuple[int, str, list[str], list[tuple[list[str], list[list[str]]]]]]]


def plain_text(path: str, content: bytes) -> Iterator[tuple[int, str, list[str], list]]:
    """Pages apart by form feeds, blocks by blank lines."""
    import re

    for n, page in enumerate(content.decode("utf-8", "replace").split("\f")):
        yield n, page, [b for b in re.split(r"\n\s*\n", page) if len(b.strip()) >= 10], []


def html_text(path: str, content: bytes) -> Iterator[tuple[int, str, list[str], list]]:
    """One page of an HTML file: its text blocks, and its tables with the first row as headers."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.tables, self.text, self.cell, self.skip = [], [], [], None, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.cell = []
            elif tag in ("p", "div", "li", "h1", "h2", "h3", "br"):
                self.flush()

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("td", "th") and self.cell is not None:
                self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif tag in ("p", "div", "li", "h1", "h2", "h3"):
                self.flush()

        def handle_data(self, data):
            if not self.skip:
                (self.text if self.cell is None else self.cell).append(data)

        def flush(self):
            block = " ".join("".join(self.text).split())
            if block:
                self.blocks.append(block)
            self.text = []

    r = Reader()
    r.feed(content.decode("utf-8", "replace"))
    r.flush()
    tables = [(t[0], t[1:]) for t in r.tables if len(t) >= 2 and any(t[0])]
    yield 0, "\n".join(r.blocks), [b for b in r.blocks if len(b) >= 5], tables


def read_pages(spark: SparkSession, path: str, parser: Parser = plain_text, **options) -> DataFrame:
    """Pages of files, parsed on the executors; doc_id is the file's content hash."""
    files = spark.read.format("binaryFile").options(**options).load(path).select(file_id(F.col("content")).alias("doc_id"), "path", "content")
    return parse_pages(files, parser)


def parse_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """Pages from rows of (doc_id, path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, path, content in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                for n, text, blocks, tables in parser(path, bytes(content)):
                    rows.append((doc_id, n, text, blocks, [{"headers": h, "rows": r} for h, r in tables]))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "raw_text", "blocks", "tables"])

    return files.mapInPandas(run, schemas.PAGE)


def read_fact_cache(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON lines {"key": "doc:...", "facts": [...]}; malformed lines and facts are left out."""
    raw = spark.read.schema(f"key string, facts array<struct<{schemas.RAW_FACT.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.where("_corrupt is null and key is not null").select(F.split("key", ":")[0].alias("doc_id"), F.posexplode("facts").alias("fact_seq", "f"))
    return rows.where("f.subject is not null and f.predicate is not null and f.value is not null").select("doc_id", "fact_seq", "f.*")


def read_extraction(answers: DataFrame) -> DataFrame:
    """Raw facts from rows of (doc_id, batch, answer), the answer being JSON text; what doesn't parse yields nothing."""
    parsed = answers.select("doc_id", "batch", F.from_json("answer", schemas.RAW_FACTS).alias("a"))
    return parsed.select("doc_id", "batch", F.posexplode("a.facts").alias("seq", "f")).where("f.subject is not null").select("doc_id", "batch", "seq", "f.*")


LEDGER = ["doc_id", "subject", "predicate", "value", "numeric_value", "canonical_value", "canonical_unit", "unit", "dimension", "temporal", "scope", "conditions", "page", "confidence", "match_type", "evidence_quote"]


def ledger(facts: DataFrame, search: str | None = None, doc_id: str | None = None, match_type: str | None = None) -> DataFrame:
    """Facts by a search word in subject, metric, value or quote, a document, and a kind of match; 'unverified' also takes what isn't verified."""
    out = facts
    if search:
        word = F.lit(search.lower())
        out = out.where(F.lower("subject").contains(word) | F.lower("predicate").contains(word) | F.lower("value").contains(word) | F.lower(F.coalesce("evidence_quote", F.lit(""))).contains(word))
    if doc_id:
        out = out.where(F.col("doc_id") == doc_id)
    if match_type == "unverified":
        out = out.where(~F.coalesce("verified", F.lit(False)) | (F.col("match_type") == "unverified"))
    elif match_type:
        out = out.where(F.col("match_type") == match_type)
    return out


def write_ledger(facts: DataFrame, path: str) -> None:
    """CSV with a header row, all fields quoted, quotes doubled."""
    facts.select(*LEDGER).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
