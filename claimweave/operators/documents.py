"""Pages: scans, running headers, quotes, chunks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T


def pages_of_text(documents: DataFrame) -> DataFrame:
    """doc_id, page_number, raw_text from texts whose pages are apart by form feeds."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page_number", "raw_text"))


def scanned_pages(pages: DataFrame, config: Config = Config()) -> DataFrame:
    return pages.where(F.length(F.btrim(F.coalesce("raw_text", F.lit("")))) < config.scanned_chars)


def skipped_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.btrim(F.coalesce("raw_text", F.lit(""))) == "") & (F.size(F.coalesce("tables", F.array().cast(dict(pages.dtypes)["tables"]))) == 0))


def running_lines(pages: DataFrame, share: float, least: int = 3) -> DataFrame:
    """doc_id, line: lines that stand among the first or last two of enough pages with four lines or more."""
    lines = F.filter(F.transform(F.split(F.coalesce("raw_text", F.lit("")), r"\R"), T.normal_space), lambda x: x != "")
    edge = pages.select("doc_id", lines.alias("ls")).where(F.size("ls") >= 4)
    edge = edge.select("doc_id", F.explode(F.concat(F.slice("ls", 1, 2), F.slice("ls", -2, 2))).alias("line"))
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    counts = edge.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).join(total, "doc_id")
    return counts.where(F.col("n") >= F.col("pages") * share).select("doc_id", "line", "n")


def without_running_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages without the lines found; one join by document, no line leaves its row."""
    held = lines.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    kept = F.filter(F.split("raw_text", r"\R"), lambda x: ~F.coalesce(F.array_contains("gone", T.normal_space(x)), F.lit(False)))
    return pages.join(held, "doc_id", "left").withColumn("raw_text", F.array_join(kept, "\n")).drop("gone")


def ground(quotes: DataFrame, pages: DataFrame, fuzzy: float = 0.8) -> DataFrame:
    """Each quote's page and kind of match: the hinted page first, then all pages of its document in order.

    quotes: quote_id, doc_id, quote, hint (may be null).  A page's best kind counts; an earlier page beats a better kind.
    """
    flat = pages.select("doc_id", "page_number", F.coalesce("raw_text", F.lit("")).alias("raw_text")).withColumn("flat_page", T.normal_space(F.col("raw_text")))
    asked = quotes.withColumn("flat_quote", T.normal_space(F.col("quote")))
    # Each text is flattened once, before the join, and not again for each pair.
    both = asked.join(flat, "doc_id").withColumn("match_type", T.quote_tier(F.col("quote"), F.col("raw_text"), fuzzy, F.col("flat_quote"), F.col("flat_page")))
    first = Window.partitionBy("quote_id").orderBy(F.when(F.col("page_number").eqNullSafe(F.col("hint")), 0).otherwise(1), "page_number")
    hits = both.where("match_type is not null").withColumn("n", F.row_number().over(first)).where("n = 1").select("quote_id", F.col("page_number").alias("found_page"), "match_type")
    out = quotes.join(hits, "quote_id", "left")
    return out.select("quote_id", "doc_id", F.coalesce("found_page", "hint").alias("page"), F.col("match_type").isNotNull().alias("verified"), F.coalesce("match_type", F.lit("unverified")).alias("match_type"))


def chunks(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """A page's tables, each a chunk, then its blocks packed in order up to a token budget."""
    tables = pages.select("doc_id", "page_number", F.posexplode("tables").alias("k", "t")).select("doc_id", "page_number", F.lit("table").alias("chunk_type"), F.col("k").alias("chunk"), T.markdown(F.col("t"), F.col("page_number")).alias("content")).where(F.btrim("content") != "")
    bins = pages.withColumn("bins", T.packed_bins(F.transform("blocks", T.tokens), config.chunk_tokens))
    merged = bins.select("doc_id", "page_number", "blocks", "bins", F.explode(F.array_distinct("bins")).alias("chunk"))
    content = F.array_join(F.transform(F.filter(F.arrays_zip("blocks", "bins"), lambda x: x["bins"] == F.col("chunk")), lambda x: x["blocks"]), "\n\n")
    texts = merged.select("doc_id", "page_number", F.lit("text").alias("chunk_type"), "chunk", content.alias("content"))
    return tables.unionByName(texts)


def page_tokens(raw_text, tables):
    """A quarter of the characters of a page and of its tables' cells; 50 at least."""
    row = lambda cells: F.length(F.array_join(cells, " "))
    of_table = lambda t: F.floor((row(t["headers"]) + F.aggregate(F.transform(t["rows"], row), F.lit(0), lambda a, n: a + n)) / 4).cast("int")
    return F.greatest(F.lit(50), F.floor(F.length(raw_text) / 4).cast("int") + F.aggregate(F.transform(tables, of_table), F.lit(0), lambda a, n: a + n))


def page_batches(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, page_number, batch: pages for one extraction request; tables that go on aren't cut."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    tabled = F.size("tables") > 0
    rows = pages.withColumn("next_tabled", F.coalesce(F.lead(tabled).over(order), F.lit(False)))
    one = F.struct("page_number", page_tokens(F.coalesce("raw_text", F.lit("")), F.col("tables")).alias("tokens"), tabled.alias("tabled"), "next_tabled")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("ps"))
    binned = docs.select("doc_id", F.explode(F.arrays_zip("ps", T.page_bins(F.col("ps"), config.batch_tokens, config.batch_pages).alias("batch"))).alias("x"))
    return binned.select("doc_id", "x.ps.page_number", "x.batch")


def fixed_batches(pages: DataFrame, size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")) - 1
    return pages.select("doc_id", "page_number", F.floor(n / size).cast("int").alias("batch"))


def prompts(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """One text for each batch: its pages in order, each with its tables."""
    tables = F.array_join(F.filter(F.transform("tables", lambda t: T.markdown(t, F.col("page_number"))), lambda m: m != ""), "\n\n")
    section = F.concat(F.lit("[page "), F.col("page_number").cast("string"), F.lit("]\n"), F.coalesce("raw_text", F.lit("")), F.when(tables != "", F.concat(F.lit("\n\n"), tables)).otherwise(""))
    parts = pages.join(batches, ["doc_id", "page_number"]).select("doc_id", "batch", "page_number", section.alias("s"))
    return parts.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "s"))), lambda x: x["s"]), "\n\n").alias("prompt"))


def table_quality(tables: DataFrame) -> DataFrame:
    """Share of empty cells of each table (doc_id, table_id, headers, rows) and whether it is a fragment."""
    cells = F.flatten("rows")
    blank = F.size(F.filter(cells, lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""))
    return tables.select("doc_id", "table_id", F.size("rows").alias("n_rows"), F.size("headers").alias("n_columns"), F.when(F.size(cells) > 0, blank / F.greatest(F.size(cells), F.lit(1))).otherwise(1.0).alias("empty_share"), ((F.size("rows") < 2) | (F.size("headers") < 2)).alias("fragment"))


def progress(batches: DataFrame, job: str, order: str) -> DataFrame:
    """Percent of a job's batches that are done when each is."""
    mine = Window.partitionBy(job)
    done = F.count(F.lit(1)).over(mine.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return batches.withColumn("percent", 100.0 * done / F.count(F.lit(1)).over(mine))


def highlighted(facts: DataFrame, word_boxes: DataFrame, least: int = 3) -> DataFrame:
    """Word boxes of a fact's page whose cleaned word stands in its quote (words of `least` characters or more)."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}.%]", "")
    tokens = facts.select("fact_id", "doc_id", "page", F.explode(F.array_distinct(F.transform(F.split("evidence_quote", r"\s+"), clean))).alias("token")).where(F.length("token") >= least)
    boxes = word_boxes.withColumn("token", clean(F.col("word"))).where(F.length("token") >= least)
    return boxes.join(tokens, ["doc_id", "page", "token"]).select("fact_id", "doc_id", "page", "seq", "word")
