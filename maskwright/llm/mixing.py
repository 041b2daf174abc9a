"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, save, shared_dir, with_running_total, word_count

#: Production parameters: weights repeat over the sources in order; the share is of all sizes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Target of every source, from (source, size) rows: columns source, source_size, source_start, target.

    A source's level is its cap by its weight. Sources clamp in order of level; the others share
    what the clamped leave, by weight, and the first of them whose share is within its cap ends the
    clamping, which is where resharing again and again ends too. ``source_start`` is the size of the sources before, nulls last.
    One row for each source is sorted, never the documents.
    """
    by = sizes.groupBy(source).agg(F.sum("size").cast("long").alias("source_size"))
    last = F.col(source).isNull().cast("int")
    order = Window.orderBy(last, source)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        source,
        "source_size",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("long").alias("source_start"),
        F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).alias("_w"),
        (F.lit(epochs) * F.col("source_size")).alias("_cap"),
        (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())).alias("_all"),
    )
    level = Window.orderBy(F.col("_cap") / F.col("_w"), last, source)
    by = by.withColumns(
        {
            "_filled": F.coalesce(F.sum("_cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("_w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    by = by.withColumn("_fits", F.col("_w") * (F.col("_all") - F.col("_filled")) / F.col("_weights") <= F.col("_cap"))
    fit = F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), "_filled", "_weights"))
    by = by.withColumn("_left", F.min(fit).over(Window.partitionBy()))
    share_of = F.col("_w") * (F.col("_all") - F.col("_left._filled")) / F.col("_left._weights")
    target = F.when(F.col("_left").isNull() | (F.col("_cap") < share_of), F.col("_cap").cast("double")).otherwise(share_of)
    return by.select(source, "source_size", "source_start", target.cast("double").alias("target"))


def seeded_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, carry=()
) -> DataFrame:
    """One row per document: id, source, size, source_size, target and taken, the words that the mix takes.

    Every document of a source is taken floor(target / source_size) whole times. The rest of the
    target goes to documents in seeded order, once more each, the last of them in part, so a
    source's taken words are its rounded target and no document exceeds ``epochs`` times its size. Null text has size 0,
    the null source is a source of its own; a source without words has target 0. Repeated rows count
    as documents; rows alike in id, source and size are interchangeable. An empty table gives no rows.
    ``carry`` names columns that stay with their row, such as one that tells repeated rows apart.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "mix")
    rows = save(
        docs.select(
            F.col(id_col),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            *carry,
        ).withColumns({"_last": F.col("source").isNull().cast("int"), "_key": seeded_key(id_col, seed)}),
        where + "/sizes",
    )
    targets = save(source_targets(rows, "source", weights, share, epochs).coalesce(1), where + "/targets")
    placed = with_running_total(rows, ["_last", "source", "_key", id_col, "size", *carry], "size", "_before", where + "/ranges")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quota = F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_quota") - (F.col("_before") - F.col("source_start"))))
    out = (
        placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", whole)
        .withColumn("_quota", quota)
        .select(id_col, "source", "size", "source_size", "target", (F.col("size") * F.col("_whole") + extra).cast("long").alias("taken"), F.col("_whole").alias("whole_epochs"), *carry)
    )
    remove(spark, where + "/sizes")
    return out
