"""Variant groups of names across rows: leaders elected in rounds, for lists that no row or task could hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import shared_folder
from .entities import spelling

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """Distinct strings of n code points in a text, in time that grows with its length."""
    signs = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.get(F.transform(F.array(signs), lambda s: F.array_distinct(F.filter(F.transform(s, lambda _, i: F.concat(*[F.get(s, i + k) for k in range(n)])), lambda g: g.isNotNull()))), F.lit(0))


def holds(classes: DataFrame) -> DataFrame:
    """(_l, outer, inner): every pair of different spellings of a list of which one holds the other.

    A spelling is looked for under its rarest three signs only, shorter ones under all of theirs, and compared once with each that has them; one of no signs is in all.
    """
    each = lambda n: classes.filter(F.length("tight") >= n).select("_l", F.col("tight").alias("outer"), F.explode(grams(F.col("tight"), n)).alias("gram"))
    threes = each(GRAM)
    often = threes.groupBy("_l", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = threes.join(often, ["_l", "gram"]).groupBy("_l", F.col("outer").alias("inner")).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    pairs = threes.join(rarest, ["_l", "gram"])
    for n in range(1, GRAM):
        short = classes.filter(F.length("tight") == n).select("_l", F.col("tight").alias("inner"), F.col("tight").alias("gram"))
        pairs = pairs.unionByName(each(n).join(short, ["_l", "gram"]))
    blank = classes.filter("tight = ''").select("_l", F.col("tight").alias("inner"))
    found = pairs.filter(F.contains("outer", "inner")).select("_l", "outer", "inner")
    return found.unionByName(classes.select("_l", F.col("tight").alias("outer")).join(blank, "_l")).filter("outer <> inner")


def variant_leaders(terms: DataFrame, within: tuple[str, ...] = ("category",), folder: str | None = None) -> DataFrame:
    """(*within, term, leader) for each distinct term of (*within, ord, term): the groups of ``with_variant_groups``, of lists of any length.

    Terms of a list come by falling length, then ``ord``; each joins the first leader that it is alike to or leads a group of its own. Names that share a longer word, or are one spelling
    but for spaces and hyphens, are all alike, so such a set is a hub: in each round it tells its members its first open name and its leader, if any, and never pairs them. Only spellings
    that hold one another are pairs. A name with a leader among its hubs is a member; one that is first in all of them leads. Hub minima have partial sums; rounds are written to a
    folder of their own under ``spark.checkpoint.dir``, and their number is that of the longest chain of names that wait for one another. Null terms are left out, null lists are a list.
    """
    spark = terms.sparkSession
    root = folder or shared_folder(spark, "variants")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    named = terms.filter("term is not null").select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], "ord", "term")
    lists = [f"_w{k}" for k in range(len(within))]
    rows = named.groupBy(*lists, "term").agg(F.min("ord").alias("ord")).withColumn("_s", spelling(F.col("term")))
    order = F.struct((-F.length("term")).alias("n"), "ord", "term")
    home = F.concat(F.lit("t"), F.col("_s.tight"))
    hubs = F.array_append(F.transform(F.array_distinct("_s.words"), lambda w: F.concat(F.lit("w"), w)), home)
    nodes = keep(rows.select(F.to_json(F.struct(*lists)).alias("_l"), *lists, order.alias("o"), F.col("_s.tight").alias("tight"), hubs.alias("hubs")), "names")
    pairs = keep(holds(nodes.select("_l", "tight").distinct()), "pairs")
    near = lambda a, b: pairs.select("_l", F.concat(F.lit("t"), a).alias("hub"), F.concat(F.lit("t"), b).alias("other"))
    beside = near("outer", "inner").unionByName(near("inner", "outer"))
    in_hubs = lambda df: df.select("_l", F.explode("hubs").alias("hub"), "o")

    def told(known: DataFrame) -> DataFrame:
        """(_l, hub, first, lead) with what hubs beside a hub know."""
        least = [F.min(c).alias(c) for c in ("first", "lead")]
        own = known.groupBy("_l", "hub").agg(*least)
        others = beside.join(own.withColumnRenamed("hub", "other"), ["_l", "other"]).select("_l", "hub", "first", "lead")
        return own.unionByName(others).groupBy("_l", "hub").agg(*least)

    nothing = lambda df, c: F.lit(None).cast(df.schema["o"].dataType).alias(c)
    as_lead = lambda df: in_hubs(df).select("_l", "hub", nothing(df, "first"), F.col("o").alias("lead"))
    waiting, leaders, k = nodes.select("_l", "o", "hubs"), [nodes.select("_l", "o", "hubs").limit(0)], 0
    while not waiting.isEmpty():
        k += 1
        # who still waits had no leader among the earlier ones, so only those of the last round can be its own
        known = in_hubs(waiting).select("_l", "hub", F.col("o").alias("first"), nothing(waiting, "lead")).unionByName(as_lead(leaders[-1]))
        seen = in_hubs(waiting).join(told(known), ["_l", "hub"]).groupBy("_l", "o").agg(F.min("first").alias("first"), F.min("lead").alias("lead"))
        seen = seen.filter("lead is null").select("_l", "o", (F.col("first") == F.col("o")).alias("leads"))
        step = keep(waiting.join(seen, ["_l", "o"]), f"round-{k}")
        leaders.append(step.filter("leads").drop("leads"))
        waiting = step.filter("not leads").drop("leads")
    mine = in_hubs(nodes).join(told(as_lead(reduce(DataFrame.unionByName, leaders))), ["_l", "hub"]).groupBy("_l", "o").agg(F.min("lead").alias("lead"))
    out = nodes.join(mine, ["_l", "o"])
    return out.select(*[F.col(a).alias(c) for a, c in zip(lists, within)], F.col("o.term").alias("term"), F.col("lead.term").alias("leader"))
