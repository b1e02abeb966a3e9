"""Documents, facts, reports and graphs as Parquet tables under one path.

Facts and documents are partitioned by doc_id and replaced by partition, so a
document's rows change without touching others; reports are appended.  A path and
a session are all the state there is: opening a store again finds everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.components import checkpointed

_TABLES = {
    "documents": schemas.DOCUMENT,
    "pages": schemas.PAGE,
    "facts": schemas.FACT,
    "reports": schemas.REPORT,
    "clusters": "graph_id string, cluster_id string, first_ordinal long, subject string, predicate string, case_type string, dispute_code string, size long, doc_count long, edge_count long, consensus_value string, explanation string, updated_at timestamp",
    "members": "graph_id string, cluster_id string, fact_id string, ordinal long, credibility double, updated_at timestamp",
    "edges": "graph_id string, cluster_id string, src string, tgt string, edge_type string, detection_method string, confidence double, explanation string, channel int, l_ordinal long, r_ordinal long, updated_at timestamp",
}
_PART = {"documents": "doc_id", "pages": "doc_id", "facts": "doc_id", "reports": "doc_id", "clusters": "graph_id", "members": "graph_id", "edges": "graph_id"}


def with_extracted(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with whether they have facts, and how many."""
    counts = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts"))
    return documents.join(counts, "doc_id", "left").withColumns({"extracted": F.col("facts").isNotNull(), "facts": F.coalesce("facts", F.lit(0))})


def without_facts(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Requested doc_ids without facts."""
    return wanted.select("doc_id").distinct().join(facts.select("doc_id").distinct(), "doc_id", "left_anti")


def latest(reports: DataFrame) -> DataFrame:
    """Each document's last report; of two at one time that of more facts.  One aggregation, no sort of a partition."""
    return reports.groupBy("doc_id").agg(F.max_by(F.struct(*reports.columns), F.struct("created_at", "total_facts")).alias("r")).select("r.*")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        """A table; empty if nothing was ever written."""
        if not self._exists(name):
            return self.spark.createDataFrame([], _TABLES[name])
        # The declared types, partition column included, whatever its values look like.
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], _TABLES[name]).schema
        have = set(rows.columns)
        return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions that the rows belong to; all others stay."""
        part = _PART[name]
        out = self._fit(name, rows)
        # A partition that holds much, such as a whole graph, is written by many tasks; AQE splits what is skewed.
        out.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        self._fit(name, rows).write.mode("append").partitionBy(_PART[name]).parquet(f"{self.path}/{name}")

    def _drop(self, name: str, value: str | None = None) -> bool:
        """Delete one partition, or a whole table; says whether it was there."""
        from urllib.parse import quote

        where = f"{self.path}/{name}" + (f"/{_PART[name]}={quote(value, safe=' -_.#@+,()')}" if value is not None else "")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True))

    # ---- documents and facts

    def documents(self) -> DataFrame:
        """Documents, newest first, with whether their facts were extracted."""
        return with_extracted(self.table("documents"), self.table("facts")).drop("facts").orderBy(F.desc("created_at"), "doc_id")

    def document(self, doc_id: str) -> DataFrame:
        return self.table("documents").where(F.col("doc_id") == doc_id)

    def facts(self, doc_id: str | None = None) -> DataFrame:
        rows = self.table("facts")
        return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)

    def page(self, doc_id: str, number: int) -> DataFrame:
        return self.table("pages").where((F.col("doc_id") == doc_id) & (F.col("page_number") == number))

    def has(self, name: str, key: Column) -> bool:
        return not self.table(name).where(key).limit(1).isEmpty()

    def missing(self, wanted: DataFrame) -> DataFrame:
        return without_facts(wanted, self.table("facts"))

    def delete(self, doc_id: str) -> bool:
        """A document with its pages, facts, and the reports that name it on either side."""
        for name in ("facts", "pages"):
            self._drop(name, doc_id)
        # Reports of other documents against this one: rewrite their partitions without them.
        touched = self.table("reports").where(F.col("cross_doc_id") == doc_id).select("doc_id").distinct()
        if not touched.isEmpty():
            left = checkpointed(self.table("reports").join(touched, "doc_id", "left_semi").where(~F.col("cross_doc_id").eqNullSafe(F.lit(doc_id))))
            for (other,) in checkpointed(touched).toLocalIterator():
                self._drop("reports", other)
            self.append("reports", left)
        self._drop("reports", doc_id)
        return self._drop("documents", doc_id)

    def delete_facts(self, doc_id: str | None = None) -> bool:
        return self._drop("facts", doc_id)

    def clear(self) -> None:
        for name in _TABLES:
            self._drop(name)

    # ---- reports and graphs

    def save_report(self, rows: DataFrame) -> None:
        self.append("reports", rows.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())) if "created_at" in rows.columns else rows.withColumn("created_at", F.current_timestamp()))

    def latest_reports(self) -> DataFrame:
        return latest(self.table("reports"))

    def save_graph(self, graph, graph_id: str = "latest") -> None:
        for name, rows in (("clusters", graph.clusters), ("members", graph.members.join(graph.scores.withColumnRenamed("score", "credibility"), "fact_id", "left")), ("edges", graph.edges)):
            self.upsert(name, rows.withColumn("graph_id", F.lit(graph_id)).withColumn("updated_at", F.current_timestamp()))

    def graph(self, graph_id: str = "latest") -> dict[str, DataFrame]:
        return {name: self.table(name).where(F.col("graph_id") == graph_id) for name in ("clusters", "members", "edges")}
