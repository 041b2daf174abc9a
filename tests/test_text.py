"""Text functions and replacement on pinned vectors, and native against exact."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import masking as K
from maskwright.functions import text as X


def one(spark, value, schema="v string", **cols):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize(
    "text,pairs,expected",
    [
        ("Synthese_IA_LaPoste_mois", [("LaPoste", "[ENTREPRISE_5]")], "Synthese_IA_[ENTREPRISE_5]_mois"),
        ("Synthese IA La Poste mois", [("La Poste", "[ENTREPRISE_4]"), ("LaPoste", "[ENTREPRISE_5]")], "Synthese IA [ENTREPRISE_4] mois"),
        ("Synthese-IA-LaPoste-mois", [("La Poste", "[ENTREPRISE_4]"), ("LaPoste", "[ENTREPRISE_5]")], "Synthese-IA-[ENTREPRISE_5]-mois"),
        ("Extrait (LaPoste) v2", [("LaPoste", "[ENTREPRISE_5]")], "Extrait ([ENTREPRISE_5]) v2"),
        ("Synthese_LaPosteXY_mois", [("LaPoste", "[X]")], "Synthese_LaPosteXY_mois"),
        ("A B C D", [("B C D", "[2]"), ("A B", "[1]")], "A [2]"),
        ("Jean, personne", [("personne", "[2]"), ("Jean", "[PERSONNE_1]")], "[PERSONNE_1], [2]"),
        ("the the", [("the", "[1]")], "[1] [1]"),
        ("É é", [("é", "[1]")], "[1] [1]"),
    ],
)
def test_masks(spark, text, pairs, expected):
    assert K.mask(text, pairs) == expected
    assert one(spark, text, v=K.mask_fixed(F.col("v"), pairs)).v == expected


def test_native_equals_exact(spark):
    rng = random.Random(1)
    words = ["ab", "AB", "abc", "é", "x9", "_", "-", " ", "ab cd", "cd", ".", "ab-cd"]
    rows = [("".join(rng.choice(words) for _ in range(rng.randrange(25))),) for _ in range(400)] + [(None,), ("",), (" ab",)]
    pairs = K.longest_first([("ab", "[A_1]"), ("ab cd", "[A_2]"), ("é", "[A_3]"), ("cd", "[B_1]"), ("x9", "[B_2]"), ("ab-cd", "[B_3]")])
    assert K.native_fits(pairs) and not K.native_fits([("-", "x")])
    got = spark.createDataFrame(rows, "t string").select("t", K.mask_native(F.col("t"), pairs).alias("n")).collect()
    assert all(r.n == (None if r.t is None else K.mask(r.t, pairs)) for r in got)


def test_segments_keep_formats():
    runs = ["La ", "Direction Juridique", "", " gère ", "Paris", " et ", "Lille"]
    pairs = [("Direction Juridique", "[E]"), ("Paris", "[P]"), ("Lille", "[L]")]
    assert K.segments(runs, K.ranges("".join(runs), pairs)) == [("La ", 0), ("[E]", 1), (" gère ", 3), ("[P]", 4), (" et ", 5), ("[L]", 6)]
    assert K.segments(["ab", "cd"], [(1, 3, "[X]")]) == [("a", 0), ("[X]", 0), ("d", 1)]


def test_trim_and_names(spark):
    assert one(spark, "\xa0\x1c a\xa0b \x1f\n", v=X.trim_py(F.col("v"))).v == "a\xa0b"
    for name, safe in [("a [x] – b.", "a (x) - b"), ("a .", "a "), ('<>:"/\\|?*\x01', "__________"), ("...", "document"), ("", "document")]:
        assert one(spark, name, v=X.safe_name(F.col("v"))).v == safe
    r = one(spark, ".hid", a=X.stem(F.col("v")), b=X.rename_stem(F.col("v")), c=X.extension(F.col("v")))
    assert (r.a, r.b, r.c) == ("", ".hid", "")
    assert one(spark, "x.tar.docx", b=X.rename_stem(F.col("v")), k=X.keep_title(F.col("v"))) == ("x.tar", "x.tar_ANO.docx")
    assert one(spark, " Été & Cie! ", v=X.slug(F.col("v"))).v == "ete-cie" and one(spark, "!!", v=X.slug(F.col("v"))).v == "client"
    assert one(spark, "autres", v=X.mapping_type(F.col("v"))).v == "autre" and one(spark, "lieux", v=X.mapping_type(F.col("v"))).v == "lieux"
    assert one(spark, "A.DocX", v=X.file_type(F.col("v"))).v == "docx" and one(spark, "a.pdf", v=X.file_type(F.col("v"))).v is None
    assert one(spark, "YES", v=X.flag(F.col("v"))).v and not one(spark, "no", v=X.flag(F.col("v"))).v


def test_positions_and_emails(spark):
    t = "🙂 a@b.co, A@B.CO x a@b.co é@x.fr c.d+e@f-g.org"
    r = one(spark, t, v=X.emails(F.col("v")))
    assert [(e.entity, t[e.start : e.end]) for e in r.v] == [("a@b.co", "a@b.co"), ("c.d+e@f-g.org", "c.d+e@f-g.org")]


def test_span_split(spark):
    t = "x Hélène\n  ETTAHAR \n\nPierre CAYET"
    r = one(spark, t, v=X.split_on_newlines(F.col("v"), F.lit(0))).v
    assert [p.entity for p in r] == ["x Hélène", "ETTAHAR", "Pierre CAYET"] and all(t[p.start : p.end] == p.entity for p in r)


def test_terms(spark):
    assert one(spark, "a, B;b\n\n c ", v=X.split_terms(F.col("v"))).v == ["a", "B", "b", "c"]
    assert one(spark, ["x ", "X", "", "y"], "v array<string>", v=X.distinct_terms(F.col("v"))).v == ["x", "y"]


def test_small_displays(spark):
    r = one(spark, 1536, "v long", a=X.byte_size(F.col("v")), b=X.percent_done(F.lit(1), F.lit(3)), c=X.percent_done(F.lit(0), F.lit(0)), d=X.middle_cut(F.lit("a" * 50)))
    assert r.a == "1.5 KB" and r.b == 33 and r.c == 0 and len(r.d) == 40 and "..." in r.d


def test_positions_of_a_long_text(spark):
    """A megabyte with a hundred thousand hits: each place is right, and it takes seconds."""
    import time

    text = "ab the é " * 100_000
    df = spark.createDataFrame([(text,)], "text string")
    t = time.time()
    got = df.select(X.positions(F.col("text"), F.lit("the")).alias("p")).select(F.explode("p")).select("col.*").toPandas()
    assert time.time() - t < 60
    assert got["start"].tolist() == [9 * k + 3 for k in range(100_000)] and (got["end"] - got["start"] == 3).all()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 5000])
def test_running_sum(spark, n):
    got = spark.range(1).select(X.running_sum(F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n), lambda x: x.cast("int"))).alias("s")).first().s
    assert got == [k * (k + 1) // 2 for k in range(n)]


def test_masking_is_native(spark):
    """No Python in the plan of fixed terms; codes in the text survive; terms of several words go first."""
    from maskwright.functions.masking import mask, mask_fixed

    pairs = [("La Poste", "[E_1]"), ("Poste", "[E_2]"), ("rue de la Poste", "[L_1]"), ("straße", "[L_2]"), ("é", "[X_1]")]
    texts = ["rue de LA POSTE, la poste et Poste_ Postes", "  La Poste", "STRASSE Straße É e", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, text string").select("i", "text", mask_fixed(F.col("text"), pairs).alias("m"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    ordered = sorted(pairs, key=lambda p: -len(p[0]))
    for r in df.collect():
        assert r.m == (None if r.text is None else mask(r.text, ordered))


def test_own_pairs_are_replaced_natively(spark):
    """Each row's own pairs, in their order, without a Python node, as the plain form does; long texts are cut in windows."""
    rng = random.Random(2)
    words = ["ab", "AB", "abc", "é", "x9", "_", "-", " ", "ab cd", "cd", ".", "ab-cd", "🙂", "\n"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    some = [("ab", "[A_1]"), ("ab cd", "[A_2]"), ("É", "[A_3]"), ("cd", "[B_1]"), ("x9", "[B_2]"), ("ab-cd", "[B_3]"), ("-", "[B_4]"), ("B CD", "[B_5]"), (".", "$1"), ("cd ab", "\\")]
    rows = [(text(rng.randrange(30)), rng.sample(some, rng.randrange(1, 6))) for _ in range(300)]
    rows += [(text(4000), some), (None, some), ("ab", None), ("ab", []), ("", some), ("ab", [("", "x")]), ("A B C D", [("B C D", "[2]"), ("A B", "[1]")]), ("Jean, personne", [("personne", "[2]"), ("Jean", "[PERSONNE_1]")]), ("the the", [("the", "[1]")])]
    df = spark.createDataFrame(rows, f"text string, pairs {K.PAIRS}").withColumn("m", K.mask_exact(F.col("text"), F.col("pairs")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        pairs = [tuple(p) for p in r.pairs or [] if p["original"]]
        assert r.m == (r.text if r.text is None else K.mask(r.text, pairs))


def test_placeholders_in_a_row(spark):
    rows = [([("b", "personnes"), ("a", "lieux"), ("b", "lieux"), ("c", "personnes"), ("d", "odd"), ("e", "autres"), (None, "mails")],), ([],)]
    df = spark.createDataFrame(rows, "v array<struct<k:string,c:string>>")
    got = [r["_marks"] for r in X.with_numbers(df, "v", lambda x: x["k"], lambda x: x["c"]).collect()]
    assert got == [["[PERSONNE_1]", "[LIEU_1]", "[PERSONNE_1]", "[PERSONNE_2]", "[SENSIBLE_1]", "[SENSIBLE_2]", "[MAIL_1]"], []]


def test_scans_short_and_long(spark):
    """Short lists are one fold, longer ones blocks; both give the sums before each element."""
    df = spark.createDataFrame([([k % 7 for k in range(n)],) for n in (0, 1, 255, 256, 257, 3000)], "a array<int>")
    for r in df.select("a", X.running_sum(F.col("a")).alias("s")).collect():
        assert r["s"] == [sum(r["a"][:k]) for k in range(len(r["a"]))]


def test_spans_are_worked_out_once_and_sorted_natively(spark):
    """Neither a filter on the size of what is exploded nor a comparison of spans by an expression where none overlap."""
    from maskwright import queries as Q

    plan = Q.Q["overlap_greedy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") and "Filter (size(" not in plan
    spans = [[(0, 4, 1, 0), (5, 9, 1, 1)], [(0, 4, 1, 0), (3, 9, 1, 1), (9, 10, 1, 2)], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s array<struct<start:int,end:int,score:int,seq:int>>")
    got = [[tuple(x)[:2] for x in r[0]] for r in df.orderBy("i").select(X.greedy_spans(F.col("s"), X.by_length_then_score)).collect()]
    assert got == [[(0, 4), (5, 9)], [(3, 9), (9, 10)], []]
