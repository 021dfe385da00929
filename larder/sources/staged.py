"""A sink that publishes a batch's tables at once, and the readers beside it.

Every attempt at a batch writes to folders of its own. It counts once its manifest stands under the
batch's name, and that name can be taken only once: the manifest is written whole elsewhere and then
moved there by the file system, which refuses if the name exists. So of several writers of one batch
one wins, whatever the others have written; attempts that broke off or lost are never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "batches"
_MANIFEST = "batch string, attempt string, at timestamp, tables array<string>"


def place_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole under a name that doesn't exist yet; False, and nothing written, if it does.

    On local disks a hard link takes the name, elsewhere the rename of Hadoop's file systems. The rename must
    refuse an existing name in one step, as HDFS does; stores without that need a single writer.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    folder, draft = target.getParent(), hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    files.mkdirs(folder)
    if files.getUri().getScheme() == "file":
        local = lambda p: unquote(urlparse(files.makeQualified(p).toString()).path)
        with open(local(draft), "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(local(draft), local(target))
        except FileExistsError:
            return False
        finally:
            os.unlink(local(draft))
        return True
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    won = not files.exists(target) and files.rename(draft, target)
    if not won:
        files.delete(draft, False)
    return won


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt, at, tables) of the batches that were published: one small file each."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/{PUBLISHED}").where("batch IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], _MANIFEST)


def published(spark: SparkSession, folder: str) -> list[str]:
    """The names of published batches in their order, for people; readers use :func:`manifests`."""
    return [r.batch for r in manifests(spark, folder).select("batch", "at").orderBy("at", "batch").collect()]


def is_published(spark: SparkSession, folder: str, batch: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{PUBLISHED}/{batch}.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def commit(spark: SparkSession, folder: str, batch: str, tables: dict[str, DataFrame]) -> str:
    """Write every table, then publish the batch in one step; the attempt's name. A published batch is refused.

    The name of a batch is a plain one, without slashes. If another writer publishes it meanwhile, this one fails.
    """
    if not batch or any(c in batch for c in "/\\=") or batch[0] in "._":
        raise ValueError(f"{batch!r} is no name for a batch")
    if is_published(spark, folder, batch):
        raise ValueError(f"batch {batch!r} is published already")
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/staged/{name}/_batch={batch}/_attempt={attempt}")
    at = spark.range(1).select(F.current_timestamp().cast("string").alias("at")).first().at
    told = json.dumps({"batch": batch, "attempt": attempt, "at": at, "tables": sorted(tables)})
    if not place_once(spark, f"{folder}/{PUBLISHED}/{batch}.json", told):
        raise ValueError(f"batch {batch!r} is published already")
    return attempt


def each_batch(folder: str, name: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that commits each micro-batch of the stream ``name`` once.

    A stream that restarts runs its last batch again, under the same number: what is published already is left.
    """

    def write(rows: DataFrame, number: int) -> None:
        batch = f"{name}-{number:012d}"
        if not is_published(rows.sparkSession, folder, batch):
            commit(rows.sparkSession, folder, batch, tables(rows))

    return write


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a table in all published batches.

    Attempts are folders of the table, so only those that a manifest names are read: their names join as
    partitions, and nothing passes through the driver.
    """
    return _rows_of(spark, folder, name, schema, manifests(spark, folder).select(F.col("batch").alias("_batch"), F.col("attempt").alias("_attempt")))


def _rows_of(spark: SparkSession, folder: str, name: str, schema: str, attempts: DataFrame) -> DataFrame:
    columns = spark.createDataFrame([], schema).columns
    try:
        rows = spark.read.schema(f"{schema}, _batch string, _attempt string").parquet(f"{folder}/staged/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(attempts, ["_batch", "_attempt"], "left_semi").select(*(f"`{c}`" for c in columns))


def rebuild(spark: SparkSession, folder: str, version: str, tables: dict[str, DataFrame]) -> str:
    """Replace derived tables as a whole: readers of :func:`read_latest` see the old ones until all new ones are there."""
    return commit(spark, folder, version, tables)


def read_latest(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a table in the batch that was published last among those that have the table; rows that it lacks are gone."""
    known = manifests(spark, folder).where(F.array_contains("tables", name))
    last = known.agg(F.max(F.struct("at", "batch", "attempt")).alias("m")).select(F.col("m.batch").alias("_batch"), F.col("m.attempt").alias("_attempt"))
    return _rows_of(spark, folder, name, schema, last)
