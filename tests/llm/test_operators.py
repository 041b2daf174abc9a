"""Operators' own interfaces: real outputs, damage, repeated rows and parameters."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm.components import connected_components
from maskwright.llm.common import shared_dir
from maskwright.llm.gru import Model, initial
from maskwright.llm.induced import suffix_order
from maskwright.llm.jaccard import jaccard_components
from maskwright.llm.license_scan import known_licenses, license_scan
from maskwright.llm.lm import lm_scores
from maskwright.llm.mixing import mix_sources, source_targets
from maskwright.llm.packing import hilbert_key, pack_documents, tail_lengths
from maskwright.llm.quality import RULES, Rule, quality_rules
from maskwright.llm.records import read_at, read_records, write_records
from maskwright.llm.suffix import suffix_dedup
from maskwright.llm.tokens import TextEncoder, encoded, tokenizer_path
from maskwright.llm.topk import build_shard, search_block, top_k
from maskwright.llm.warc import read_archive, write_archive


def test_encoder_equals_library(texts):
    e = TextEncoder(tokenizer_path())
    assert e.memo_ok
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)]
    assert [x.tolist() for x in encoded(e, texts.values(), 500)] == want
    assert [e.encode(t).tolist() for t in texts.values()] == want


def test_record_offsets_and_damage(spark, sf):
    where = shared_dir(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = write_records(docs, where, tokenizer_path(), file_bytes=4000)
    listed = index.orderBy("doc_id").collect()
    assert len({r.file for r in listed}) > 3
    for r in random.Random(1).sample(listed, 5):
        doc_id, ids = read_at(r.file, r.offset)
        assert doc_id == r.doc_id and len(ids) == r.n_tokens
    path = listed[0].file.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        read_records(index).collect()


def test_records_repeat_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    got = read_records(write_records(docs, shared_dir(spark, "t"), tokenizer_path())).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(1, 0, 2), (1, 2, 2), (2, 4, 1)]
    docs = docs.unionByName(spark.createDataFrame([(None, "b"), (None, None)], docs.schema))
    got = read_records(write_records(docs, shared_dir(spark, "t"), tokenizer_path())).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got if r.doc_id)[0] == (3, 1, 2) and sorted(r.n_tokens for r in got if r.doc_id is None) == [1, 2]


def test_warc_records(spark, sf):
    where = shared_dir(spark, "t")
    write_archive(spark.read.parquet(f"{sf}/pages.parquet"), where)
    got = {r.page_id: r for r in read_archive(spark, where).collect()}
    assert spark.read.parquet(where + "/payloads").count() == len({r.digest for r in got.values()})
    page = got[3]
    assert page.record_type == "revisit" and page.refers_to == 0 and bytes(page.record).startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")
    assert bytes(got[0].record).endswith(bytes(got[0].payload) + b"\r\n\r\n")
    assert got[93].record_type == "response" and got[90].payload == b""
    broken = spark.read.parquet(where + "/payloads").withColumn("payload", F.lit(b"no"))
    broken.write.parquet(where + "-b/payloads")
    spark.read.parquet(where + "/headers").write.parquet(where + "-b/headers")
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, where + "-b").collect()


def test_license_spellings(spark):
    body = "Copyright (c) 2024 A Person\n\nPermission to use, copy, modify, and/or distribute this SOFTWARE for any purpose with or without fee is hereby granted.\n"
    from maskwright.llm.license_scan import KNOWN_TEXTS

    whole = dict(KNOWN_TEXTS[:5])["0BSD"].replace(",", " ;").upper()
    rows = [(1, "(c) Me\n" + whole), (2, "x\nreleased UNDER the MIT Licence!\ny"), (3, None), (4, ""), (5, body), (2, "x\nreleased UNDER the MIT Licence!\ny"), (6, "---")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()
    assert sorted((r.doc_id, r.license_id or "", r.notices) for r in got) == [(1, "0BSD", ""), (2, "", "MIT"), (2, "", "MIT"), (3, "", ""), (4, "", ""), (5, "", ""), (6, "", "")]
    assert {r.doc_id for r in got if r.text_digest is None} == {3, 4, 6}


def test_license_forms(spark, monkeypatch):
    """Whole texts with titles, wrapped anew, with rights lines and without what follows the terms."""
    import textwrap

    from maskwright.llm import license_scan as L

    mit, bsd = L.KNOWN_TEXTS[0][1], dict(L.KNOWN_TEXTS[:5])["BSD-3-Clause"]
    wrapped = mit.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    apache, gpl = (dict(L.shipped_texts()[::-1])[k] for k in ("Apache-2.0", "GPL-3.0"))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A Person\n\n" + wrapped),
        (2, "The MIT License (MIT)\n\nCopyright Jane Doe\n" + "\n".join(textwrap.wrap(mit, 40))),
        (3, "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + bsd),
        (4, "\n".join(textwrap.wrap(apache[: apache.index("END OF TERMS") + 27], 60))), (5, gpl[: gpl.index("END OF TERMS") + 27]), (6, "MIT License"), (7, mit + " Not."), (8, "word " * 400_000 + mit), (None, mit),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' license_id", "'y' _ids")
    got = {r.doc_id: r.license_id for r in license_scan(docs, known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "Apache-2.0", 5: "GPL-3.0", 6: None, 7: None, 8: None, None: "MIT"}
    notices = [(f"N-{k % 2}", f"Notice number {k} without that word") for k in range(9)]
    docs = spark.createDataFrame([(1, "notice number 3 without that word\nNotice, number 4 without that word.\nx"), (1, "x"), (2, None)], "doc_id long, text string")
    few = sorted((r.doc_id, r.notices, r.n_notices) for r in license_scan(docs, known_licenses(spark, notices)).collect())
    monkeypatch.setattr(L, "MOST_NOTICES", 3)
    assert few == sorted((r.doc_id, r.notices, r.n_notices) for r in license_scan(docs, known_licenses(spark, notices)).collect()) == [(1, "", 0), (1, "N-0,N-1", 2), (2, "", 0)]


def test_quality_table(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_words", F.lit("old"))
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in texts.items():
        r = got[i]
        assert r.kept == (not r.base_failed and all(_passes(rule, r) for rule in RULES)), t
    strict = {r.doc_id for r in quality_rules(docs, rules=(Rule("words", "n_words", None, 50, None),)).filter("kept").collect()}
    assert strict == {i for i, r in got.items() if not r.base_failed and r.n_words >= 50}


def _passes(rule, r):
    if r.n_words < rule.from_words or (rule.denominator and not r[rule.denominator]):
        return True
    v = r[rule.numerator] / (r[rule.denominator] if rule.denominator else 1)
    return (rule.least is None or v >= rule.least) and (rule.most is None or v <= rule.most)


def test_water_filling_by_resharing(spark):
    rng = random.Random(5)
    sizes = [(None if k == 7 else f"s{k:02d}", rng.choice([0, 1, 50, 1000, 10**6])) for k in range(12)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: [5, 2, 1][k % 3] for k, (s, _) in enumerate(order)}
    cap = {s: 2 * n for s, n in sizes}
    left, open_, target = 1.5 * sum(n for _, n in sizes), set(cap), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= over
        if not open_:
            break
    target |= share if open_ else {}
    assert got == pytest.approx(target)


def test_mixing_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 9


def test_hilbert_curve_steps():
    bits, dims = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_groups_and_copies(spark):
    assert sum(tail_lengths(3001, 4096)) == 3001 and all(n & (n - 1) == 0 for n in tail_lengths(3001, 4096))
    docs = spark.createDataFrame([(k, "alpha beta gamma " * (k % 50)) for k in range(300)] + [(1, "alpha beta gamma ")], "doc_id long, text string")
    small = pack_documents(docs, tokenizer_path(), length=64, group_ids=500).collect()
    assert sum(r.length for r in small) == sum(3 * (k % 50) + 1 for k in range(300)) + 4
    assert max(r.offset + r.length for r in small) <= 64


@pytest.mark.parametrize("levels", [2, 256])
def test_topk_walk_is_exact(levels):
    rng = np.random.default_rng(2)
    rows = rng.integers(-40, 40, (600, 12))
    rows[100:140] = rows[0]
    ids = np.arange(600)
    shard = build_shard(ids, rows, levels)
    asked = np.array([0, 5, 130])
    for q, (found, scores) in zip(asked, search_block(shard, asked, rows[asked], 20)):
        want = sorted((-int(s), int(i)) for i, s in zip(ids, rows @ rows[q]) if i != q)[:20]
        assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want


def test_topk_large_components():
    rng = np.random.default_rng(4)
    rows = rng.integers(-(1 << 28), 1 << 28, (50, 8))
    (found, scores), = search_block(build_shard(np.arange(50), rows), np.array([3]), rows[3:4], 20)
    assert [(-int(s), int(i)) for i, s in zip(found, scores)] == sorted((-int(s), i) for i, s in enumerate(rows @ rows[3]) if i != 3)[:20]


def test_topk_shapes(spark):
    v = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (20, [0.5, 0.5, 0.5]), (21, [1.0, 2.0])]
    got = top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(21, 64 * 64 * 5), (20, 32 * 64 * 3), (1, 4096), (2, 0)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 400)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark, "t")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(300, 400)]}


@pytest.mark.parametrize("percent,width", [(80, 5), (50, 1), (100, 2)])
def test_jaccard_against_all_pairs(spark, percent, width):
    rng = random.Random(percent)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        w = list(base) if k % 2 else [rng.choice(base) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = rng.choice(base)
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)})
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(60):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, width, percent).collect()} == {k: find(k) for k in range(60)}


def test_suffix_order_spills(tmp_path):
    rng = np.random.default_rng(6)
    for t in range(60):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        if t % 3 == 0:
            text = np.append(np.tile(text[:3] + 1, 12), 0)
        got = np.concatenate(list(suffix_order(text, int(text.max()) + 1, memory=8, folder=str(tmp_path)))).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert not list(tmp_path.iterdir())


def test_suffix_text_and_spans(spark):
    a, b = "x" * 10 + "the quick brown fox jumps over the lazy dog again and again", "é" * 30
    rows = [(2, a + "tail"), (1, "head" + a), (3, b + b), (4, "y" + b), (4, "y" + b), (5, None)]
    got = [r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()]
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].n_removed == 0 and by[2].n_removed == len(a) and by[2].spans == [0, len(a)] and bytes(by[2].kept) == b"tail"
    assert by[4].n_removed == 60 and bytes(by[4].kept) == b"y" and by[5].n_bytes == 0


def test_gru_gradients_and_windows():
    counts = np.sort(np.random.default_rng(1).integers(1, 50, 30))[::-1].astype(float)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30, n) for n in (0, 1, 5, 40, 17)]
    m = Model(initial(counts))
    m.p["Wo"] += rng.normal(size=m.p["Wo"].shape).astype(np.float32)
    m.p["Wc"] += rng.normal(size=m.p["Wc"].shape).astype(np.float32)
    whole = m.run(docs, 0, window=64)
    assert np.allclose(whole, m.run(docs, 0, window=3, lanes=2), rtol=1e-4)
    # probabilities of the next token sum to one
    s = rng.normal(size=(1, m.p["Uh"].shape[0])).astype(np.float32)
    each = [m._outputs(s, np.array([k]), None)[0][0] for k in range(30)]
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)
    # training lowers the loss of a learnable pattern
    pattern = [np.tile([3, 7, 11, 2], 30) for _ in range(16)]
    before = m.run(pattern, 0).sum()
    for _ in range(15):
        m.run(pattern, 0, learn=True)
    assert m.run(pattern, 0).sum() > before / 2


def test_lm_learns_on_held_out(spark):
    rng = random.Random(9)
    kinds = [["la", "casa", "de", "el"], ["the", "house", "of", "a"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(60))) for k in range(400)]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert {r.doc_id for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0}


def test_lm_frequent_words_are_tokens(spark):
    """1,500 words are all tokens of their own: without training a text's score is that of their smoothed shares."""
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    train = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10)
    text = " ".join(f"w{k}x" for k in range(1500))
    rows = [(train, text), (held, text)]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    total = 1501 + 0.5 * (1 + 64 + 1500)
    assert got[held].score == pytest.approx(1501 * np.log10(1.5 / total), rel=1e-4)
    assert initial(np.ones(4))["Uh"].shape == (24, 72)


def test_walk_falls_and_stops():
    """Levels come by falling impact; a clear winner ends the walk before the last level, with the exact answer; huge components too."""
    from maskwright.llm import topk as T

    rng = np.random.default_rng(5)
    rows = rng.integers(-3, 4, (2000, 16))
    query = rng.integers(-3, 4, 16)
    rows[:40] = query * np.array([40] * 20 + [30] * 20)[:, None]
    for scale in (1, 1 << 24):
        data, q = rows * scale, query * scale
        seen = []
        shard = T.build_shard(np.arange(2000), data)
        ids, scores = T.search(shard, -1, q, 10, -(1 << 62), lambda b, impact, left: seen.append((b, impact.min(), impact.max(), left)))
        exact = data.astype(object) @ q.astype(object)
        order = sorted(range(2000), key=lambda i: (-exact[i], i))[:10]
        assert ids.tolist() == order and scores.tolist() == [exact[i] for i in order]
        assert all(x[1] >= y[2] for x, y in zip(seen, seen[1:])) and seen[-1][0] < T.BANDS - 1 and len(seen) > 1


@pytest.mark.parametrize("scale", [1, 1 << 24])
@pytest.mark.parametrize("levels", [8, 256])
def test_walk_reads_few_postings(scale, levels):
    """Vectors without structure: the proof comes before three quarters of the postings, for exact and shared levels, packed and large sums; a common vector's ties stay exact."""
    from maskwright.llm import topk as T

    rng = np.random.default_rng(11)
    rows = np.floor(8 * rng.normal(size=(4000, 64))).astype(np.int64) * scale
    ids = rng.permutation(8000)[:4000]
    shard, share = T.build_shard(ids, rows, levels), []
    for j in range(6):
        order = [i for i in np.lexsort((ids, -(rows @ rows[j]))) if i != j][:20]
        floor, seen = int(rows[order[-1]] @ rows[j]), []
        got, scores = T.search(shard, ids[j], rows[j], 20, floor, lambda b, impact, left: seen.append((impact.min(), left)))
        assert got.tolist() == ids[order].tolist() and scores.tolist() == (rows[order] @ rows[j]).tolist()
        least, product = min(x[0] for x in seen), rows * rows[j]
        share.append(np.mean((np.abs(product) if least >= 0 else product) >= least))
        assert levels < 256 or seen[-1][1] <= T.RESCORE * 4000
    assert levels < 256 or np.mean(share) < 0.75
    rows[1000:] = rows[0]
    (got, scores), = T.search_block(T.build_shard(ids, rows, levels), ids[:1], rows[:1], 20)
    assert got.tolist() == sorted(ids[1000:])[:20] and set(scores.tolist()) == {int(rows[0] @ rows[0])}


@pytest.mark.parametrize("value", [0, 3, 1 << 27])
def test_walk_over_equal_vectors(value):
    """One impact for all: every vector ties, in one level, and the smallest ids win."""
    rows = np.full((500, 4), value)
    for k, (found, scores) in enumerate(search_block(build_shard(np.arange(500), rows), np.array([0, 7]), rows[:2], 20)):
        assert found.tolist() == [i for i in range(21) if i != 7 * k][:20] and set(scores.tolist()) == {4 * value * value}


def test_common_pages_are_split(spark, monkeypatch):
    """A digest of many pages goes to several tasks and gives the same records."""
    from maskwright.llm import warc as W

    html = "x" * 200
    pages = spark.createDataFrame([(k, f"u{k}", html) for k in range(40)] + [(50, None, None), (None, "n", html), (51, "u", "y" * 300)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'z' payload", "1 part")
    rows = lambda where: sorted((str(r.page_id), r.record_type, r.refers_to, bytes(r.record)) for r in read_archive(spark, where).collect())
    a, b = shared_dir(spark, "t"), shared_dir(spark, "t")
    write_archive(pages, a)
    monkeypatch.setattr(W, "HOT", 4)
    write_archive(pages, b)
    assert spark.read.parquet(b + "/headers").select("part").distinct().count() > 5
    assert rows(a) == rows(b) and [x[1] for x in rows(a)].count("response") == 3


def test_scores_repeat(spark, texts):
    """Two runs, dealt differently, give the same scores; an id that is null is held out."""
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    run = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.score) for r in lm_scores(df, unit_bytes=2000).collect())
    a = run(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = run(docs.repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [x[:3] for x in a] == [x[:3] for x in b] and max(abs(x[3] - y[3]) for x, y in zip(a, b)) < 1e-6 and a[0][:3] == (-1, True, 3)


def test_network_against_plain():
    """Log probabilities of the network equal a plain one-by-one form, however a text lies in windows and lanes."""
    from maskwright.llm import gru

    rng = np.random.default_rng(3)
    n = 30
    p = gru.initial(np.sort(rng.integers(1, 90, n))[::-1].astype(float))
    p = {k: v + (rng.normal(size=v.shape) * 0.3).astype(np.float32) * (v > -1e3) for k, v in p.items()}
    docs = [rng.integers(0, n, k) for k in (1, 40, 7, 90)]
    got = gru.Model(p).run(docs, 0, lanes=2, window=16)
    H, size = gru.HIDDEN, gru.class_size(n)
    for doc, found in zip(docs, got):
        h, x, want = np.zeros(H), 0, 0.0
        for y in doc:
            a, u = p["E"][x] @ p["Wx"] + p["b"], h @ p["Uh"]
            z, r = (np.clip(0.25 * (a + u)[k * H : (k + 1) * H] + 0.5, 0, 1) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(a[2 * H :] + r * u[2 * H :])
            c = h @ p["Wc"] + p["bc"]
            o = p["Wo"][y // size] @ h + p["bo"][y // size]
            want += c[y // size] - np.log(np.exp(c).sum()) + o[y % size] - np.log(np.exp(o).sum())
            x = y
        assert abs(want - found) < 1e-3


def test_null_ids(spark):
    """Rows without an id are kept by the operators on sets and suffixes, and change nothing for the others."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, same), (2, same), (None, same), (None, None)], "doc_id long, text string").selectExpr("*", "7 n", "'k' class_key")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == [("1", 11, 1), ("2", 11, 1), ("None", 0, None), ("None", 11, None)]
    size = len(same)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup(docs).collect())
    assert got == [("1", size, 0), ("2", size, size), ("None", 0, 0), ("None", size, 0)]
    packed = pack_documents(docs, tokenizer_path()).collect()
    assert sum(r.doc_id is None for r in packed) >= 2 and sum(r.length for r in packed) == sum({(str(r.doc_id), r.doc_tokens): r.doc_tokens for r in packed}.values())


def test_a_long_text_costs_few_windows(monkeypatch):
    """Windows grow where few lanes are left, in training and scoring; scores are those of short windows."""
    from maskwright.llm import gru

    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 90, n) for n in [4000, *[40] * 63]]
    calls = []
    learn = gru.Model._learn
    monkeypatch.setattr(gru.Model, "_learn", lambda self, *a: calls.append(a[0].shape) or learn(self, *a))
    m = gru.Model(gru.initial(np.sort(rng.integers(1, 90, 90))[::-1].astype(float)))
    m.run(docs, 0, learn=True)
    assert len(calls) < 40 and sum(s for s, _ in calls) == 4000
    assert np.allclose(gru.Model(m.p).run(docs, 0), gru.Model(m.p).run(docs, 0, lanes=1, window=5), rtol=1e-4)
