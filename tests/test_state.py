"""Versioned tables, keyed job state, run alignment and search among many logos."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.functions import masking as K
from maskwright.operators import images as I
from maskwright.sources import versions as V
from maskwright.streaming import jobs as J

RUNS = "id int, runs array<string>, pairs array<struct<original:string,placeholder:string>>"


def aligned(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RUNS)
    df = df.withColumn("spans", K.pair_spans(F.array_join(F.transform("runs", lambda x: F.coalesce(x, F.lit(""))), ""), F.col("pairs")))
    return [[(p["text"], p["run"]) for p in r["segments"]] for r in K.with_segments(df, "runs", "spans").orderBy("id").collect()]


def test_runs_keep_their_text(spark):
    pairs = [("Direction Juridique", "[ENTREPRISE_1]"), ("Paris", "[LIEU_2]"), ("Lille", "[LIEU_1]")]
    split = [("Paris", "[LIEU_1]")]
    got = aligned(spark, [(["La ", "Direction Juridique", " gère ", "Paris", " et ", "Lille"], pairs), (["", "Pa", "", "ris", " x"], split), (["", ""], split), ([], split), (None, split), (["a", None, "b"], split)])
    assert got[0] == [("La ", 0), ("[ENTREPRISE_1]", 1), (" gère ", 2), ("[LIEU_2]", 3), (" et ", 4), ("[LIEU_1]", 5)]
    assert got[1] == [("[LIEU_1]", 1), (" x", 4)]
    assert got[2:] == [[], [], [], [("a", 0), ("b", 2)]]


def test_alignment_equals_the_plain_form(spark):
    rng = random.Random(5)
    pairs = K.longest_first([("ab", "[X_1]"), ("ab cd", "[X_2]"), ("é", "[X_3]"), ("d", "[X_4]")])
    rows = [(["".join(rng.choice("abcdé  ") for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 30))], pairs) for _ in range(60)]
    want = [[(t, k) for t, k in K.segments(runs, sorted(K.ranges("".join(runs), pairs))) if t] for runs, _ in rows]
    assert aligned(spark, rows) == want


def test_null_spans_are_none(spark):
    df = spark.createDataFrame([(["a", "b"], None)], "runs array<string>, spans array<struct<start:int,end:int,mark:string>>")
    assert [tuple(p) for p in K.with_segments(df, "runs", "spans").first()["segments"]] == [("a", 0), ("b", 1)]


def test_alignment_is_one_step_over_columns(spark):
    """No expression goes over the runs one by one; rows without runs, long ones and signs beyond the basic plane lie in one batch."""
    runs = ["Pa", "ris", " 𝒳", "é "] * 20_000
    rows = [([], [("Paris", "[L]")]), (runs, [("Paris", "[L]")]), (None, None), (["𝒳Paris", "𝒳"], [("𝒳paris𝒳", "[M]"), ("Paris", "[L]")])]
    got = aligned(spark, rows)
    assert got[0] == got[2] == [] and got[3] == [("[M]", 0)]
    assert got[1] == [p for k in range(0, 80_000, 4) for p in (("[L]", k), (" 𝒳", k + 2), ("é ", k + 3))]
    df = K.with_segments(spark.createDataFrame([(["a"], None)], "runs array<string>, spans array<struct<start:int,end:int,mark:string>>"), "runs", "spans")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan


def test_many_logos_equal_one_array_of_them(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = lambda: f"{rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(25))) & (1 << 64) - 1:016x}"
    images = [(k, rng.choice(["p", "q", "hot", "hot", "hot", None, "none", "nulls"]), near() if rng.random() > 0.05 else None) for k in range(600)]
    images += [(1000 + k, "hot", images[0][2] or near()) for k in range(50)]
    logos = [(rng.choice(["p", "q", "hot", None]), near() if rng.random() > 0.05 else None) for _ in range(300)] + [("nulls", None), ("hot", "0" * 16), ("hot", "f" * 16), ("other", near())]
    a = spark.createDataFrame(images, "doc_id int, project_id string, phash string")
    b = spark.createDataFrame(logos, "project_id string, logo_hash string")
    want = sorted(map(str, I.match_logos(a, b).collect()))
    assert sorted(map(str, I.match_many_logos(a, b, image_block=40, logo_block=16).collect())) == want
    assert sorted(map(str, I.match_many_logos(a, b).collect())) == want
    assert {r["status"] for r in I.match_many_logos(a, b.limit(0)).collect()} == {"review"}
    assert I.match_many_logos(a.limit(0), b).count() == 0


def rows_of(df):
    return sorted((r["id"], r["name"]) for r in df.collect())


def client(spark, *pairs):
    return spark.createDataFrame([(i, n, ["t"], "2024") for i, n in pairs], V.CLIENT_SCHEMA)


def test_a_lost_writer_leaves_the_last_version(spark, tmp_path):
    root = f"file://{tmp_path}/clients"
    assert V.read_version(spark, root, schema=V.CLIENT_SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, root)
    assert V.save_clients(spark, root, client(spark, ("a", "A"), ("b", "B"))) == 1
    client(spark, ("z", "lost")).write.parquet(f"{root}/data/{2:020d}-lost")
    (tmp_path / "clients" / "commits" / f".{2:020d}-lost").write_text("{half")
    assert rows_of(V.read_version(spark, root)) == [("a", "A"), ("b", "B")]
    assert V.save_clients(spark, root, client(spark, ("b", "B2"))) == 2
    assert rows_of(V.read_version(spark, root)) == [("a", "A"), ("b", "B2")] and rows_of(V.read_version(spark, root, 1)) == [("a", "A"), ("b", "B")]
    assert V.remove_client(spark, root, "none") is None and V.remove_client(spark, root, "a") == 3
    assert rows_of(V.read_version(spark, root)) == [("b", "B2")]
    assert V.remove_client(spark, root, "b") == 4 and V.read_version(spark, root).columns == ["id", "name", "terms", "created_at"]
    assert V.vacuum(spark, root, keep=2) == []
    assert len(V.vacuum(spark, root, keep=2, older_ms=-1000)) == 3 and V.versions(spark, root) == [3, 4]
    assert rows_of(V.read_version(spark, root, 3)) == [("b", "B2")]


def test_two_writers_of_one_version(spark, tmp_path):
    root = f"file://{tmp_path}/clients"
    V.save_clients(spark, root, client(spark, ("a", "A")))
    calls = []

    def change(old):
        calls.append(rows_of(old))
        if len(calls) == 1:  # another writer is first
            V.save_clients(spark, root, client(spark, ("b", "B")))
        return old.unionByName(client(spark, ("c", "C")))

    assert V.rewrite(spark, root, change) == 3
    assert calls == [[("a", "A")], [("a", "A"), ("b", "B")]]
    assert rows_of(V.read_version(spark, root)) == [("a", "A"), ("b", "B"), ("c", "C")]
    with pytest.raises(V.Conflict):
        V.commit_version(client(spark, ("d", "D")), root, 1)
    assert rows_of(V.read_version(spark, root, 2)) == [("a", "A"), ("b", "B")]


def test_jobs_progress_expire_and_start_anew(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "job_id string, status string, ts timestamp"

    def step(*events):
        """Send events of (job, status, minute) and give the progress rows of that batch."""
        before = seen()
        rows = [(j, s, None if m is None else start + timedelta(minutes=m)) for j, s, m in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.run_jobs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        new = seen()
        for r in before:
            new.remove(r)
        return sorted(new)

    def seen():
        return [tuple(r) for r in spark.read.schema(J.PROGRESS).parquet(f"{tmp_path}/out").collect()] if (tmp_path / "out").exists() else []

    got = step(("a", "waiting", 0), ("a", "waiting", 0), ("b", "waiting", 0), ("a", "done", 1), (None, "done", 1), ("c", "done", None))
    assert got == [("a", 2, 1, 0, 0, 50, False), ("b", 1, 0, 0, 0, 0, False)]
    # a goes on; b has heard nothing for an hour when the watermark passes minute 60
    got = step(("a", "error", 50), ("d", "waiting", 75), ("d", "skipped", 75))
    assert got == [("a", 2, 2, 1, 0, 100, False), ("b", 1, 0, 0, 0, 0, True), ("d", 1, 1, 0, 1, 100, False)]
    # behind the watermark (minute 65): dropped; b begins anew within it
    got = step(("a", "done", 2), ("b", "waiting", 70), ("d", "waiting", 76))
    assert got == [("b", 1, 0, 0, 0, 0, False), ("d", 2, 1, 0, 1, 50, False)]
    got = step(("e", "waiting", 400))
    assert got == [("a", 2, 2, 1, 0, 100, True), ("b", 1, 0, 0, 0, 0, True), ("d", 2, 1, 0, 1, 50, True), ("e", 1, 0, 0, 0, 0, False)]
