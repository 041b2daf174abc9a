"""Shared storage, table access and ordered prefix sums for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import spread

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of fewer splits than cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing a temporary folder is used, in local mode only.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/maskwright/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, where: str, codec: str = "zstd") -> DataFrame:
    """Write as Parquet and reread: a cut of the lineage that survives lost executors."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    df.write.mode("overwrite").option("compression", codec).parquet(where)
    return df.sparkSession.read.schema(schema).parquet(where)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of finished intermediate tables."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """(file system, path) for a URI; runs on executors."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, n_bytes: int, each: int = 128 << 20) -> int:
    """Tasks for a shuffle of so many bytes: the session's number, or more where a task would get over ``each``."""
    return max(partitions(spark), -(-n_bytes // each))


def rows_to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key of more rows is served from a small table; at most ``MOST_HOT`` keys are, the commonest, so a key left has at most that share of all rows.
HOT, MOST_HOT = 1_000, 10_000


def join_commonest(left: DataFrame, right: DataFrame, key: str, rows: str, spread_by: str) -> DataFrame:
    """Left join to a saved table with one row for each key, whose column ``rows`` says how many left rows have it.

    The commonest keys, a bounded number, are broadcast; left rows that they serve, and those whose key is null, are dealt by ``spread_by``
    instead of by key, so no task gets a common key's rows.
    """
    values = [c for c in right.columns if c not in (key, rows)]
    packed = right.select(key, rows, F.struct(*values).alias("_rest"))
    top = packed.filter(F.col(rows) > HOT).orderBy(F.desc(rows), key).limit(MOST_HOT).select(key, F.col("_rest").alias("_hot"))
    served = left.join(F.broadcast(top), key, "left")
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(1 << 30)) + 1).cast("long")
    joined = served.withColumn("_salt", salt).join(packed.drop(rows).withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    found = F.coalesce("_hot", "_rest")
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])


def with_running_total(df: DataFrame, order: list[str], value: str, out: str, where: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows ordered before this one.

    Rows are dealt by range of ``order`` (so a heavy leading key spreads over many tasks when later
    keys differ), summed by range, and the sums, one row for each range, are added up and
    broadcast: their number is the number of shuffle partitions, whatever the data. The order must be total for
    a fixed result; ``order`` is ascending, nulls first.
    """
    n = partitions(df.sparkSession)
    dealt = save(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()),
        where,
    )
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(bases), "_range")
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
        .drop("_range", "_base")
    )
