"""One object for what a caller does: ingest, extract, compare, reconcile, append, look up."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import documents as docs_ops
from .operators import edges
from .operators.components import checkpointed
from .plans import graph as plans
from .plans.extraction import normalised
from .sources import backends, files
from .sources.store import Store
from .streaming import append


@dataclass
class Job:
    """Progress of a run: percent, what it does now, and its failure if it has one."""

    job_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    percent: int = 0
    step: str = "queued"
    error: str | None = None
    began: float = field(default_factory=time.time)
    listener: Callable[[int, str], None] | None = None

    def at(self, percent: int, step: str) -> None:
        self.percent, self.step = percent, step
        if self.listener:
            self.listener(percent, step)


def page_range(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages first to last of each document, both included; a range outside of a document is refused."""
    most = pages.agg(F.max("page_number")).first()[0]
    low, high = 0 if first is None else first, most if last is None else last
    if most is None or low < 0 or high < low or high > most:
        raise ValueError(f"no pages {low} to {high}; pages go from 0 to {most}")
    return pages.where(F.col("page_number").between(low, high))


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages, text blocks and tables of each document."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("blocks")).alias("text_blocks"), F.sum(F.size("tables")).alias("tables"))


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), model: Callable[[], backends.Cascade] | None = None, scorer=None, embeddings: DataFrame | None = None, parser: files.Parser = files.plain_text):
        self.spark, self.store, self.config = spark, Store(spark, path), config
        self.model, self.scorer, self.embeddings, self.parser = model, scorer, embeddings, parser
        self.jobs: dict[str, Job] = {}

    # ---- documents

    def ingest(self, path: str, listener=None) -> tuple[DataFrame, Job]:
        """Parse files into pages and keep them; running headers and footers are taken out."""
        job = self._job(listener)
        job.at(10, "parsing")
        pages = checkpointed(files.read_pages(self.spark, path, self.parser))
        lines = docs_ops.running_lines(pages, self.config.header_share, self.config.header_pages)
        self.store.upsert("pages", docs_ops.without_running_lines(pages, lines))
        names = self.spark.read.format("binaryFile").load(path).select(files.file_id(F.col("content")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"))
        counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
        documents = names.join(counts, "doc_id").withColumn("created_at", F.current_timestamp())
        self.store.upsert("documents", documents)
        job.at(100, "done")
        return self.store.documents(), job

    def documents(self) -> DataFrame:
        return self.store.documents()

    def chunks(self, doc_id: str, max_tokens: int | None = None) -> DataFrame:
        config = Config(**{**self.config.__dict__, "chunk_tokens": max_tokens or self.config.chunk_tokens})
        return docs_ops.chunks(self.store.table("pages").where(F.col("doc_id") == doc_id), config)

    def delete(self, doc_id: str | None = None) -> None:
        self.store.clear() if doc_id is None else self.store.delete(doc_id)

    # ---- facts

    def extract(self, doc_id: str, first: int | None = None, last: int | None = None, again: bool = False) -> DataFrame:
        """Facts of a document: those at hand, unless there are none, a page range is given, or `again` is."""
        here = F.col("doc_id") == doc_id
        if not again and first is None and last is None and self.store.has("facts", here):
            return self.store.facts(doc_id)
        if self.model is None:
            raise ValueError("no extraction model is configured; use add_facts with raw facts")
        pages = page_range(self.store.table("pages").where(here), first, last)
        answers = backends.extract(docs_ops.prompts(pages, docs_ops.page_batches(pages, self.config)), self.model)
        raw = files.read_extraction(checkpointed(answers))
        order = F.row_number().over(_by_batch()) - 1
        return self.add_facts(raw.withColumn("fact_seq", order))

    def add_facts(self, raw: DataFrame) -> DataFrame:
        """Ground, normalise and keep raw facts (doc_id, fact_seq and the extracted fields)."""
        facts = checkpointed(normalised(raw, self.store.table("pages"), self.config))
        self.store.upsert("facts", facts)
        return facts

    # ---- comparison

    def contradictions(self, doc_id: str, cross_doc_id: str | None = None, nli_threshold: float | None = None) -> DataFrame:
        """Edges within a document, or within two together; the report is added to the document's history."""
        config = self.config if nli_threshold is None else Config(**{**self.config.__dict__, "nli_threshold": nli_threshold})
        other = None if cross_doc_id is None else self.store.facts(cross_doc_id)
        mine = self.store.facts(doc_id)
        found = checkpointed(edges.detect_contradictions(mine, other, config, self.scorer, self.embeddings))
        total = (mine if other is None else mine.unionByName(other)).agg(F.count(F.lit(1)).alias("total_facts"))
        listed = found.agg(F.to_json(F.collect_list(F.struct("src", "tgt", "edge_type", "confidence"))).alias("edges"))
        self.store.save_report(total.crossJoin(listed).withColumns({"doc_id": F.lit(doc_id), "cross_doc_id": F.lit(cross_doc_id).cast("string")}))
        return found

    def reconcile(self, doc_ids: list[str] | None = None, doc_authority: dict[str, float] | None = None, listener=None) -> tuple[plans.ClaimGraph, Job]:
        """Build, keep and return the graph of all facts, or of some documents'."""
        job = self._job(listener)
        try:
            facts = self.store.facts()
            if doc_ids is not None:
                wanted = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
                missing = [r.doc_id for r in self.store.missing(wanted).collect()]
                if missing:
                    raise ValueError(f"no facts of {', '.join(sorted(missing))}")
                facts = facts.join(wanted, "doc_id", "left_semi")
            job.at(20, "aligning and comparing")
            built = plans.build_claim_graph(plans.guarded(facts, self.config), self.store.table("documents"), self._overrides(doc_authority), self.config, self.scorer, self.embeddings)
            job.at(90, "saving")
            self.store.save_graph(built)
            job.at(100, "done")
            return built, job
        except Exception as error:
            job.error = str(error)
            raise

    def append(self, graph: plans.ClaimGraph, doc_id: str, doc_authority: dict[str, float] | None = None) -> append.Appended:
        """The graph with one more document's facts; kept in the store."""
        out = append.append_document(graph, self.store.facts(doc_id), self.store.table("documents"), self.config, self.scorer, self.embeddings, self._overrides(doc_authority))
        self.store.save_graph(out.graph)
        return out

    def cases(self, graph: plans.ClaimGraph) -> dict[str, DataFrame]:
        return plans.showcase(graph)

    def capabilities(self) -> dict[str, bool]:
        return backends.capabilities(self.scorer, self.model, self.parser)

    # ---- helpers

    def _job(self, listener) -> Job:
        job = Job(listener=listener)
        self.jobs[job.job_id] = job
        return job

    def _overrides(self, doc_authority: dict[str, float] | None) -> DataFrame | None:
        return self.spark.createDataFrame(list(doc_authority.items()), "doc_id string, authority double") if doc_authority else None


def _by_batch():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("batch", "seq")
