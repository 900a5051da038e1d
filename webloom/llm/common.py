"""Shared helpers: reading tables, staging intermediate tables, batching texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised pass handles at a time inside a task.
CHUNK_CHARS = 500_000

#: Rows whose remainder is 1 are held out of every fit.
HELD_OUT_REMAINDER = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(df: DataFrame) -> list[str]:
    """The names of all columns for `select`, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def free_name(taken: list[str], name: str) -> str:
    """`name`, or a longer one, that none of the `taken` names is, in either case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text), null texts as empty; other columns never clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def map_rows(docs: DataFrame, begin: Callable[[], Callable[[pa.RecordBatch, int], pa.RecordBatch]]) -> DataFrame:
    """`docs` with every batch changed by what `begin` gives in a task, from (batch, place of its texts); names may hold any characters."""
    place = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = begin()
        for batch in batches:
            yield change(batch, place)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """True for documents that no fit may learn from (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT_REMAINDER, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines must share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    import tempfile

    base = "file://" + tempfile.mkdtemp(prefix="spark-webloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/webloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: short lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_ids, texts) of about `limit` characters; a longer text comes alone, whole. Ids stay as Arrow has them, of any type."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        start, total = 0, 0
        taken: list[str] = []
        for i in range(len(ids)):
            text = texts[i].as_py() or ""
            if taken and total + len(text) > limit:
                yield ids.slice(start, i - start), taken
                start, total, taken = i, 0, []
            taken.append(text)
            total += len(text)
        if taken:
            yield ids.slice(start), taken
