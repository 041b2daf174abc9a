"""Variant groups across rows against those within a row."""

import random

from pyspark.sql import functions as F

from maskwright.operators import entities as E
from maskwright.operators import variants as W
from maskwright.plans import anonymize as A


def within_rows(spark, lists):
    rows = [(i, [(k, "c", t) for k, t in enumerate(ts)]) for i, ts in enumerate(lists)]
    df = E.with_variant_groups(spark.createDataFrame(rows, f"i int, p {A.PRESENT}"), "p")
    return sorted((r["i"], m, g["members"][0]) for r in df.collect() for g in r["groups"] for m in g["members"])


def across_rows(spark, lists):
    rows = [(i, k, t) for i, ts in enumerate(lists) for k, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    df = W.variant_leaders(spark.createDataFrame(rows, "category int, ord long, term string"))
    return sorted(tuple(r) for r in df.select("category", "term", "leader").collect())


def test_leaders_equal_the_groups_of_a_row(spark):
    rng = random.Random(8)
    words = ["jean", "Paul", "le", "Roux", "d'or", "x", "de la", "Saint-Paul", "ROUX", "ab", "-", "é", "rouxel", "pa"]
    lists = [[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(14))] for _ in range(80)]
    lists += [["Dupont", "Jean Dupont", "J. Dupont", "ACME", "La Poste", "LaPoste"], ["diane", "ia"], ["abc", "-"], ["---", "ab", ""], ["😀a", "b😀", "😀"]]
    assert across_rows(spark, lists) == within_rows(spark, lists)


def test_a_word_of_most_names_makes_no_pairs(spark):
    """A hub of thousands of names, and a chain of names that wait for one another."""
    hub = [f"sarl {k:05d}{'z' * (k % 7)}" for k in range(3000)]
    chain = [f"aa{k:03d}x aa{k + 1:03d}x" + "q" * (20 - k) for k in range(12)]
    got = across_rows(spark, [hub, chain])
    assert {x for i, _, x in got if i == 0} == {min(hub, key=lambda t: (-len(t), hub.index(t)))}
    assert [r for r in got if r[0] == 1] == [(1, *r[1:]) for r in within_rows(spark, [chain])]


def test_long_null_and_repeated_names(spark):
    rows = [(None, 0, "a" * 20000 + "bcd"), (None, 1, "BCD"), (None, 1, "BCD"), (None, 2, None), ("p", 0, "bcd"), ("p", 1, "Bcd")]
    df = spark.createDataFrame(rows, "category string, ord long, term string")
    got = sorted((str(r["category"]), r["term"][:3], r["leader"][:3]) for r in W.variant_leaders(df).collect())
    assert got == [("None", "BCD", "aaa"), ("None", "aaa", "aaa"), ("p", "Bcd", "bcd"), ("p", "bcd", "bcd")]
    assert W.variant_leaders(df.limit(0)).count() == 0
    assert W.variant_leaders(df.withColumn("lang", F.lit("fr")), ("category", "lang")).columns == ["category", "lang", "term", "leader"]
