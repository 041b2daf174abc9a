"""The corpus pipeline against a plain version, stage by stage."""

import random

import corpus_pipeline as P
from maskwright.llm.common import save, shared_dir
from test_queries import WORD, plain_dedup


def test_stages(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, where = docs.columns, shared_dir(spark, "t")
    after = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = save(stage(spark, docs, sf), f"{where}/{k}")
        after.append(docs.collect())
        assert k == 4 or docs.columns == columns
    good, single, cut, mixed, packed = after
    kept = {r.doc_id: r.text for r in good}
    assert all(kept[i] == texts[i] for i in kept) and len(WORD.findall(kept[min(kept)])) >= 10
    sets = {}
    for i, t in kept.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in single) == sorted({find(i) for i in sets})
    want = plain_dedup({r.doc_id: r.text for r in single})
    for r in cut:
        if not want[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
        assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert abs(sum(times.values()) - 1.5 * sum(len(WORD.findall(r.text)) for r in cut)) <= 5
    assert {r.doc_id for r in packed} == set(times)
    assert P.run(spark, sf).count() == len(packed)


def test_empty(spark, sf):
    assert P.run(spark, f"{sf}/none").collect() == []


def test_repeated_rows(spark, sf):
    """Rows with one id, with one text or several, neither multiply nor get each other's text."""
    rng = random.Random(5)
    prose = lambda rng, n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, three = (prose(rng, 60) for _ in range(3))
    shared = prose(rng, 30)
    schema = "doc_id long, text string, source string, n_chars long"
    row = lambda i, t: (i, t, "s", len(t))
    # three copies of a row, another text under its id
    docs = spark.createDataFrame([row(7, one)] * 3 + [row(7, two), row(9, three)], schema).repartition(3)
    assert sorted((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, sf).collect()) == sorted([(7, one), (7, two), (9, three)])
    # both texts of id 8 are cut, each to its own rest
    docs = spark.createDataFrame([row(1, shared)] + [row(8, "A" * 9 + shared)] * 3 + [row(8, "B" * 9 + shared), row(9, three)], schema).repartition(3)
    got = P.drop_repeated_spans(spark, docs, sf).collect()
    assert sorted(r.text for r in got) == sorted([shared] + ["A" * 9] * 3 + ["B" * 9, three])
    assert all(r.n_chars == len(r.text) for r in got)
    # the source's one and a half times is met in words, and no row goes in more often than the epochs
    docs = spark.createDataFrame([row(7, one)] * 4 + [row(7, two), row(9, three)], schema).repartition(3)
    got = P.mix_to_weights(spark, docs, sf).collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == 1.5 * 6 * 60
    assert sum(r.text == one for r in got) <= 8
