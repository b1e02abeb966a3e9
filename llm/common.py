"""Helpers that several operators share: inputs, the shared folder, sizes, clash-free columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python group of rows should hold.
GROUP_BYTES = 10_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that no path on their side matters."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_package", False):
        return
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), "llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.glob("*.py")):
            z.write(f, f"{here.name}/{f.name}")
    sc.addPyFile(path)
    sc._llm_package = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Where the setting is missing, a local master gets a folder of its own; on a cluster that would be one that
    executors do not see, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_llm_folder", None) != path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        spark.sparkContext._llm_folder = path
    return path


#: Short rows of a link table that one task should write.
TASK_ROWS = 200_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives a lost executor.

    With a bound on its rows, short ones, no more tasks write it than that asks for, but eight at least: a
    shuffle is cut for the whole input, and a small table would be hundreds of files of a few rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if rows is not None and (tasks := max(8, -(-rows // TASK_ROWS))) < shuffle_partitions(df.sparkSession):
        df = df.coalesce(tasks)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def group_bytes(size: int, partitions: int, most: int = GROUP_BYTES) -> int:
    """Bytes of text for one group of documents, of `size` in all.

    About `most`, or less if there are tasks to spare, but not under a tenth of that, since groups exchange
    blocks with one another.  From most**2 / 1024 on (about 100 GB) groups grow with the square root of the
    input, so that the number of blocks, groups times buckets, stays at one for each KB at most.
    """
    spare = max(most // 10, min(most, -(-size // max(1, partitions))))
    return max(spare, int((size * 1024) ** 0.5) if size * 1024 > most**2 else 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n: fixed folds.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Rows of ids that may be sent to every executor: 16 MB at most.
SMALL = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids with a broadcast hint if a count shows that it is small; else joins shuffle it."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def text_hash() -> Column:
    return F.xxhash64(text_of())


def matching(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """df's rows that are (left_semi) or aren't (left_anti) among `rows` (doc_id, text_hash): rows are named by id, null
    or not, and text, so those that only share an id do not mix."""
    keys = rows.select(F.col("doc_id").alias(fresh(df.columns, "of_id")), F.col("text_hash").alias(fresh(df.columns, "of_text"))).distinct()
    keys = small(written(keys, "rows"))
    a, b = keys.columns
    return df.join(keys, df["doc_id"].eqNullSafe(keys[a]) & (text_hash() == keys[b]), how)


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among ids.doc_id; rows without one stay."""
    gone = small(written(ids.select(F.col("doc_id").alias("gone_")).where("gone_ is not null").distinct(), "gone"))
    return df.join(gone, df["doc_id"] == gone["gone_"], "left_anti")


def fresh(taken: list[str], name: str) -> str:
    """A column name that differs from all others."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
