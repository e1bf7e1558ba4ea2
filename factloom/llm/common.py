"""What the operators of this folder share: reading tables, staging, bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch, so that a batch of very long texts stays in a worker's memory.
BATCH_ROWS = 256
#: Rows of the Arrow batches that Spark passes to workers while it writes a staged table: the JVM and each worker hold a
#: batch several times, so Spark's 10,000 rows of whole texts or sets would take much of an executor's memory.
STAGED_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader (the path may be in any store).

    A file so small that it makes fewer tasks than there are cores is dealt over them; larger ones are not shuffled.
    """
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found._jdf.queryExecution().toRdd().getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where all is one machine, a temporary folder is set where none is named; on a
    cluster each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(found)
    return found


def staged(df: DataFrame, tag: str, rows: int = STAGED_ROWS) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until the folder is cleared, as lazily read results depend on it. Workers get Arrow batches of at
    most ``rows`` rows meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{tag}-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: Spark bounds a batch's bytes, this what is made of it at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(batch) -> dict of columns`` over small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)


def counted_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key; n: how many of ``rows`` hold it, about) on ``key``.

    Keys of a thousandth of all ``total`` rows or more - a thousand at most - are joined by broadcast, so
    that no task gets all rows of one key; the others by shuffle. So few rows that one task takes them
    anyhow are joined plainly.
    """
    if total <= 20_000:
        return rows.join(table, key)
    least = max(200, total // 1000)
    hot = F.broadcast(table.where(F.col("n") > least))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= least), key)
    return rows.join(hot, key).unionByName(rest)


def split_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (one row a key) on ``key``: for each of ``rows``, about ``total``, one row at most.

    The table is staged, so that nothing stands between the join and its two shuffles: then Spark splits a partition that
    one key fills, if that is large. So few rows that one task takes them anyhow are joined plainly.
    """
    return rows.join(table if total <= 20_000 else staged(table, "keys"), key, how)


def kept_rows(docs: DataFrame, text: str, accepts) -> DataFrame:
    """Rows of ``docs``, columns as they are, for whose texts ``accepts(list of texts)`` says true."""
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots do not pass mapInArrow

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = batch.filter(pa.array(accepts(batch.column(at).to_pylist()), pa.bool_()))
            if kept.num_rows:
                yield kept

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def quoted(names: list[str]) -> list[str]:
    """Column names as Spark's parser takes them whole, dots and all."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def text_bytes(column) -> F.Column:
    """UTF-8 length of a text column, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
