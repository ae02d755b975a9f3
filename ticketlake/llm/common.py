"""Reading, durable copies and joins whose broadcasts are checked, shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators.ordering import with_rank

#: Characters of [\x20\x09-\x0D]: the white space that the text operators know.
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a private one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="ticketlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy: lineage ends here, work isn't repeated.

    The copy goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (saved) table is within the size for a broadcast; reads at most ``rows`` + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def narrowed(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join with a saved table of keys: without a shuffle of ``df`` where the keys are few."""
    keys = keys.select(*on)
    return df.join(F.broadcast(keys) if is_small(keys) else keys, list(on), how)


def free_name(wanted: str, columns: Sequence[str]) -> str:
    """A column name that is not in use."""
    used = {c.lower() for c in columns}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def with_row_number(docs: DataFrame, name: str, key: str = "doc_id", *order: str) -> DataFrame:
    """Adds a long that each row has for itself: its id, where no other row has it.

    Rows without an id and rows that share one are numbered after the greatest id, by id, ``order`` and place. Where that leaves the
    range of a long, all rows are numbered anew. Only rows to be numbered are sorted; rows that get each other's numbers
    in a rerun are equal in id and ``order``.
    """
    ids = F.col(key).cast("bigint")
    place = free_name("place", docs.columns)
    order_by = [ids.asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in order), F.col(place)]

    def ranked(rows: DataFrame, start: int) -> DataFrame:
        found = with_rank(rows.withColumn(place, F.monotonically_increasing_id()), order_by, name)
        return found.withColumn(name, F.col(name) + F.lit(start)).drop(place)

    counted = saved(docs.groupBy(ids.alias(name)).agg(F.count("*").alias("rows")).where(f"rows > 1 OR {name} IS NULL"))
    if counted.isEmpty():
        return docs.withColumn(name, ids)
    greatest = docs.agg(F.max(ids)).head()[0] or 0
    if greatest + counted.agg(F.sum("rows")).head()[0] >= 1 << 63:
        return ranked(docs, -(1 << 62))
    again = counted.select(name).where(F.col(name).isNotNull())
    known, unknown = docs.withColumn(name, ids).where(F.col(name).isNotNull()), docs.where(ids.isNull())
    alone = narrowed(known, again, [name], "left_anti")
    return alone.unionByName(ranked(narrowed(known, again, [name], "left_semi").drop(name).unionByName(unknown), max(greatest, 0)))


def lean(step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A step for ``mapInPandas`` whose task gives its memory back to the system when it ends.

    Spark keeps Python workers for the stages that follow, beside an executor whose heap has grown meanwhile.
    """

    @wraps(step)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return run
