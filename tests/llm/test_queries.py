"""Every registered query against a plain version over the fixture tables, and over empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskwright.llm import queries as Q
from maskwright.llm.suffix import minimizer_runs, split_runs, suffix_dedup
from maskwright.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows(spark, sf, name):
    return Q.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, sf, name):
    assert rows(spark, f"{sf}/none", name) == []


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = Q.QUERIES[name](spark, sf).toPandas()
    want = c.execute(Q.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else (v.item() if hasattr(v, "item") else v)
    key = lambda df: sorted(repr([float(x) if isinstance(x := plain(v), (int, float)) and not isinstance(x, bool) else x for v in r]) for r in df[cols].values.tolist())
    assert key(got) == key(want)


def test_op2_scores(spark, sf):
    found = defaultdict(list)
    for r in rows(spark, sf, "op2_topk_search"):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ok = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(found) == {i for i in ok if i % 20 == 0}
    for q, got in found.items():
        every = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q))[:20]
        assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(every)]


@pytest.fixture(scope="module")
def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_pieces(spark, sf, token_ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows(spark, sf, "op3_curve_packing"):
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(token_ids)
    for i, pieces in by_doc.items():
        ids, at = [*token_ids[i], 2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op6_components(spark, sf, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, sf, "op6_jaccard_join")}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert any(i != c for i, (_, c) in got.items())


def test_op7_records(spark, sf, token_ids):
    start = 0
    got = {r.doc_id: r for r in rows(spark, sf, "op7_token_records")}
    assert set(got) == set(token_ids)
    for i in sorted(token_ids):
        ids = [*token_ids[i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op8_sums(spark, sf):
    got = rows(spark, sf, "op8_source_mixing")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[source[r.doc_id]].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(g[0].target for g in by.values()) - 1.5 * total) < 1e-6 * total
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 1 and g[0].target <= 2 * g[0].source_size + 1e-9
    again = {r.doc_id: r.taken for r in rows(spark, sf, "op8_source_mixing")}
    assert again == {r.doc_id: r.taken for r in got}


def test_op9_base(spark, sf, texts):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in rows(spark, sf, "op9_lm_scores")}
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def plain_dedup(texts, length=50):
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op10_bytes(spark, sf, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, "op10_suffix_dedup")}
    want = plain_dedup(texts)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("hot_runs", [2, 20_000])
def test_op10_phrase_in_many_surroundings(spark, hot_runs):
    """A phrase shorter than a string, or longer, in unlike surroundings, some of which two documents share."""
    rng = np.random.default_rng(9)
    other = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    short, long, longer = other(25), other(46), other(90)
    texts, sides = {}, [other(9) for _ in range(6)]
    for i in range(80):
        a, b, c, d = (sides[k] for k in rng.integers(0, 6, 4))
        texts[i] = other(30) + a + short + b + other(20) + c + long + d + other(int(rng.integers(0, 40))) + longer[int(rng.integers(0, 30)) :] + other(10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, hot_runs=hot_runs).collect()}
    assert got == plain_dedup(texts)


def test_op10_pieces_of_a_common_minimizer():
    """Pieces partition a run's strings, equal strings share a key, and one phrase no longer holds all of them together."""
    rng = np.random.default_rng(4)
    phrase = rng.integers(97, 123, 30).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 60), phrase, rng.integers(97, 123, 60)]).astype(np.uint8) for _ in range(300)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    runs = minimizer_runs(data, ends, 50, 20)
    key, a, b, doc, _ = split_runs(data, runs, 50)
    strings = lambda first, last: sorted(x for lo, hi in zip(first, last) for x in range(lo, hi + 1))
    assert strings(a, b) == strings(runs[1], runs[2])
    key_of = {}
    for k, lo, hi in zip(key.tolist(), a, b):
        assert hi - lo < 4
        for x in range(lo, hi + 1):
            assert key_of.setdefault(data[x : x + 50].tobytes(), k) == k
    assert np.unique(runs[0], return_counts=True)[1].max() > 50
    assert np.unique(key, return_counts=True)[1].max() < 10
