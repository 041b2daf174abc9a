"""Near vectors, ranked search and conversation repair: their interfaces, hard cases and plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from maskwright.llm.lexical import Filling, Shard, build_shard, max_score, ranked_search, share, terms_of
from maskwright.llm.near_vectors import BLOCK, compare, near_vectors
from maskwright.llm.repair import Piece, Repaired, STATES, Whole, finish, repair_conversations, step


def plain_near(rows, least=0.98):
    """{position: (links, component)} by comparing all vectors of a label."""
    ok = [k for k, (i, label, x) in enumerate(rows) if i is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    ids = [r[0] for r in rows]
    links, root = Counter(), {k: k for k in range(len(rows))}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for label in {rows[k][1] for k in ok}:
        for size in {len(rows[k][2]) for k in ok}:
            some = [k for k in ok if rows[k][1] == label and len(rows[k][2]) == size]
            if not some:
                continue
            x = np.array([rows[k][2] for k in some], np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
                links[some[a]] += 1
                links[some[b]] += 1
                p, q = top(some[a]), top(some[b])
                root[max(p, q)] = min(p, q)
    least_id = {}
    for k in range(len(rows)):
        if ids[k] is not None:
            least_id[top(k)] = min(ids[k], least_id.get(top(k), ids[k]))
    return [(ids[k], links[k], least_id.get(top(k)), ids[k] == least_id.get(top(k))) for k in range(len(rows))]


def vectors(spark, rows, more=""):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, cls string, pivots int").repartition(4)


def test_near_vectors_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 3)), rng.normal(size=16).tolist()) for k in range(300)]
    for k in range(60):  # chains of near copies, some across labels
        _, label, x = rows[int(rng.integers(0, len(rows)))]
        rows.append((300 + k, label if k % 5 else (label + 1) % 3, (np.array(x) + rng.normal(size=16) * 0.04).tolist()))
    x = rows[0][2]
    rows += [(500, rows[0][1], x), (500, rows[0][1], [2 * v for v in x]), (0, rows[0][1], x), (501, None, x), (None, rows[0][1], x)]
    rows += [(502, 1, None), (503, 1, []), (504, 1, [0.0] * 16), (505, 1, [None] + x[1:]), (506, 1, [float("inf")] + x[1:]), (507, 1, x[:9]), (508, 1, x[:9]), (509, 1, [1e-200 * v for v in rows[0][2]]), (510, 1, [-0.0, 1e-200]), (511, 1, [0.0, 3.0])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows)).collect()]
    want = [(i, n, c, True if i is None else k) for i, n, c, k in plain_near(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(n > 1 for _, n, _, _ in want) > 20


def test_near_vectors_long_list_meets_block_by_block(spark):
    """More near copies than a block holds, in a ring so that not all are linked."""
    n = BLOCK + 700
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    x = np.zeros((n, 12))
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    x += np.random.default_rng(2).normal(size=x.shape) * 0.01
    rows = [(int(k), 7, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in near_vectors(vectors(spark, rows)).collect()}
    want = {i: (links, c) for i, links, c, _ in plain_near(rows)}
    found, there = sum(r.n_links for r in got.values()), sum(w[0] for w in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want) and found >= 0.99 * there
    assert {r.component_id for r in got.values()} == {0} and [i for i, r in got.items() if r.kept] == [0]


def test_near_vectors_few_points(spark):
    """All vectors in one direction leave one reference point."""
    rows = [(k, 0, [1.0, 0.001 * k]) for k in range(5)] + [(9, 0, [-1.0, 0.0])]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(vectors(spark, rows)).collect()) == [*((k, 4, 0) for k in range(5)), (9, 0, 9)]


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 64))
    rows = [(k, 0, (base[k % 700] + rng.normal(size=64) * (0 if k < 700 else 0.1)).tolist()) for k in range(2800)]
    found = sum(r.n_links for r in near_vectors(vectors(spark, rows)).collect())
    there = sum(n for _, n, _, _ in plain_near(rows))
    assert there > 5000 and found >= 0.99 * there


def test_compare_takes_a_pair_once():
    """A pair that shares several points is retrieved under the first of them only, and only with enough shared."""
    x = np.array([[1.0, 0.0], [1.0, 0.01]])
    rows = {"cls": np.array([4, 9]), "copies": np.array([2, 5]), "x": x, "pivots": np.array([[1, 2, 3, 4, 7], [0, 2, 3, 4, 7]], np.int32)}
    assert [v.tolist() for v in compare(2, rows, None)] == [[4, 9], [5, 2], [4, 4]]
    assert all(not len(v) for v in compare(3, rows, None)) and all(not len(v) for v in compare(2, rows, None, shared=5))
    one = lambda k: {c: v[k : k + 1] for c, v in rows.items()}
    assert [v.tolist() for v in compare(2, one(0), one(1))] == [[4, 9], [5, 2], [4, 4]]


def filled(docs):
    filling = Filling()
    for doc_id, words in docs:
        filling.add(doc_id, words)
    return build_shard(filling)


def plain_search(docs, items, k):
    terms = [(i, terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in terms:
            tf, s = Counter(t), 0
            for w in terms_of(text):
                if tf[w]:
                    s += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1)))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * (75 + (25 * len(t) * n_docs) // total)))
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(5)
    words = [a + b for a in ("ka", "Lo", "mü", "n0", "日") for b in ("", "r", "ß", "É", "9x")]
    text = lambda n: rng.choice(" -_\n.\x7f").join(rng.choice(words[: rng.choice((4, 25))]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(150)] + [(150, None), (151, ""), (152, " .-"), (None, text(30)), (None, text(30)), (3, text(20)), (153, text(9000))]
    docs += [(200 + k, docs[0][1]) for k in range(30)]
    items = [(k, text(12)) for k in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (None, text(5)), (1, text(6)), (28, docs[0][1])]
    return docs, items


def test_terms():
    assert terms_of("Ab-9_É\x7fÄß\x00日本 {x} y") == ["ab".encode(), b"9", "É".encode(), "Äß".encode(), "日本".encode(), b"x", " y".encode()]
    assert terms_of(None) == [] and terms_of("") == []


def test_search_against_plain(spark, searched):
    docs, items = searched
    got = ranked_search(spark.createDataFrame([(*d, 1, "f") for d in docs], "doc_id long, text string, item_id int, file string").repartition(5), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(docs, items, 20), key=str)


def test_search_walks_and_hands_on(searched):
    """Over many shards, with the threshold handed on: the same best documents, and lists are left unread."""
    docs, items = searched
    docs = [(i, t) for i, t in docs if t and terms_of(t) and i is not None]
    n_docs, total = len(docs), sum(len(terms_of(t)) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(terms_of(t)))
    shards = [Shard(filled([(i, terms_of(t)) for i, t in part]), n_docs, total) for part in (docs[a : a + 40] for a in range(0, n_docs, 40))]
    told = []
    for item, text in items:
        query = [(w, n * int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1))))) for w, n in Counter(terms_of(text)).items() if df[w]]
        best = []
        for shard in shards:
            floor = best[4][0] if len(best) >= 5 else 1
            found, points = max_score(shard, query, 5, floor, watch=lambda *x: told.append(x))
            best = sorted(best + [(int(p), int(shard.a["ids"][d])) for d, p in zip(found, points)], key=lambda x: (-x[0], x[1]))[:5]
        assert [(item, r + 1, i, s) for r, (s, i) in enumerate(best)] == plain_search(docs, [(item, text)], 5)
    assert sum(essential < lists for essential, lists, _, _ in told) > len(told) / 3


def test_shard_bounds():
    """The pairs kept for a list give its greatest share, whatever N and L turn out to be."""
    rng = random.Random(8)
    texts = [[rng.choice((b"a", b"b", b"c")) for _ in range(rng.randrange(1, 40))] for _ in range(200)]
    shard = filled(enumerate(texts))
    for docs, total in ((200, 4000), (10**6, 10**7), (300, 10**8)):
        s = Shard(shard, docs, total)
        for term in (b"a", b"b", b"c"):
            place, most, _ = s.bounded(term)
            assert most == int(share(shard["tf"][place], shard["n"][shard["docs"][place]], docs, total).max())
        assert s.bounded(b"d") is None
    assert len(shard["edge_tf"]) < len(shard["tf"]) / 3


def plain_repair(rows):
    """Counts, cost, labels and hash of (turn, role, text) in order, by best ends from the last row backwards."""
    seen, kinds, counts = set(), [], [0, 0, 0, 0]
    initials = [(role or " ")[0] for _, role, _ in rows]
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        blank, dup = not body, (role, text) in seen
        seen.add((role, text))
        cut = not blank and not dup and body[-1] not in ".!?"
        counts = [counts[0] + blank, counts[1] + (dup and not blank), counts[2] + cut, 0]
        kinds.append((blank or dup, cut))
    counts[3] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    then = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ends):
        for _ in range(4):
            ends = {g: min([w for w in (ends.get(g),) if w] + [(ends[h][0] + 3, "I" + ends[h][1]) for o in "ua" if (h := then.get((g, o))) in ends], default=None) for g in ("", "s", "u", "a")}
            ends = {g: w for g, w in ends.items() if w}
        return ends

    ends = inserted({"": (0, ""), "a": (0, "")})
    for initial, (gone, cut) in zip(initials[::-1], kinds[::-1]):
        new = {}
        for g in ("", "s", "u", "a"):
            ways = [(ends[g][0] + 4, "D" + ends[g][1])] if g in ends else []
            if not gone:
                ways += [(ends[h][0] + c + 3 * cut, e + ends[h][1]) for e, c, o in (("K", 0, initial), ("R", 3, "u"), ("R", 3, "a")) if (h := then.get((g, o))) in ends]
            if ways:
                new[g] = min(ways)
        ends = inserted(new)
    cost, audit = ends[""]
    n = len(audit) - audit.count("D")
    roles, lines, k = ["system"] * (n % 2) + ["user", "assistant"] * (n // 2), [], 0
    for e in audit:
        if e == "I":
            lines.append(roles[len(lines)] + ":")
            continue
        if e != "D":
            lines.append((rows[k][1] if e == "K" else roles[len(lines)]) + ":" + rows[k][2])
        k += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def test_repair_against_plain(spark):
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "umpire"], ["Yes.", "No", " \n", "", None, "Why?", "é!", "end \t\n", "Ok."]
    rows, convs = [], {}
    for c in [None, *range(400)]:
        some = [(rng.choice([None, *range(-2, 9)]), rng.choice(roles[: rng.choice((2, 3, 10))]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(50)}{rng.choice('.?!x')}") for _ in range(rng.randrange(1, 9))]
        rows += [(c, *r, False) for r in some]
        convs[c] = in_order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in some])
    rows += [(999, 1, "user", "gone", True), (5, 3, "user", "gone too", True)]
    convs[999] = []
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "conv_id long, turn long, role string, text string, dropped boolean, body string, kind int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == {c: plain_repair(r) for c, r in convs.items()}
    assert {e for g in got.values() for e in g[6]} == set("KRDI") and got[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_a_long_conversation(spark):
    """One conversation over several tasks and pieces, with repeated rows and a very long text."""
    rng = random.Random(12)
    rows = [(7, t, rng.choice(("user", "assistant", "assistant", "system")), f"{rng.randrange(900)}" + rng.choice((".", "", "?"))) for t in range(5000)]
    rows += rows[100:160] * 3 + [(7, 5001, "user", "long. " * 200_000), (8, 0, "user", "Hello."), (6, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == {c: plain_repair(in_order([r[1:] for r in rows if r[0] == c])) for c in (6, 7, 8)}


def test_pieces_put_together_equal_the_whole():
    rng = random.Random(13)
    rows = [(t, rng.choice("uuaas?"), rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.3) for t in range(60)]
    for cuts in ([60], [1, 2, 30, 60], list(range(1, 61))):
        whole, at = Whole(), 0
        for cut in cuts:
            piece = Piece(STATES)
            for row in rows[at:cut]:
                piece.add(*row)
            whole.add(piece.told())
            at = cut
        seen = (finish(whole.row), whole.counts, whole.gaps())
        assert cuts == [60] or seen == first
        first = seen


def test_step_is_composed_and_walked():
    arcs = {(g, h): (c, labels) for g, h, c, labels in step("a", False, True)}
    assert arcs[0, 3] == (6, "IK") and arcs[3, 3] == (4, "D") and arcs[3, 2] == (6, "R") and arcs[1, 3] == (6, "IK")
    follow = Repaired("KIDK")
    assert [*follow.row("system", "x."), *follow.row("tool", "y"), *follow.row("assistant", "z."), *follow.inserted()] == ["system:x.", "user:", "assistant:z."]


def test_clashing_names_everywhere(spark):
    """Columns named as those that operators and stages use inside stay with their rows."""
    import corpus_pipeline as P
    from maskwright.llm.jaccard import jaccard_components
    from maskwright.llm.quality import quality_rules

    names = ("_verdict", "_cut_id", "_cut_text", "_mix_size", "_row", "row", "doc", "size", "taken", "time", "cut_id", "cut_text", "rep", "mark", "_s", "_last", "_key", "_before")
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["the", "and", "of", "to"] * 8
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + ".", "s", 0, *[f"{c}{k}" for c in names]) for k in range(12)]
    rows.append((20, rows[3][1], "s", 0, *[f"{c}20" for c in names]))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    judged = quality_rules(df)
    assert judged.count() == 13 and [r._verdict for r in judged.orderBy("doc_id").select("_verdict").collect()][:2] == ["_verdict0", "_verdict1"]
    kept = df
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == df.columns
        got = kept.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert jaccard_components(df).count() == 13


def test_jaccard_signatures_are_bytes_unless_sets_are_large(spark):
    """Sizes by hash range are a byte each, two where a set is large; sets of either kind link with those of both."""
    import numpy as np

    from maskwright.llm.jaccard import jaccard_components, signatures

    short, long = [f"k{i}" for i in range(300)], [f"w{i}" for i in range(12_000)]
    edge = [f"e{i}" for i in range(7_000)]  # some ranges have 128 elements in one of the two and not in the other
    texts = [" ".join(t) for t in (short, [*short, "end"], long, [*long, "end"], edge, edge[:6_500])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signs = {r["doc_id"]: r for r in signatures(df, np.zeros(1 << 18, np.int32), 3, 90).collect()}
    assert [(signs[k]["parts"] is None, signs[k]["wide"] is None) for k in range(4)] == [(False, True)] * 2 + [(True, False)] * 2
    assert sum(signs[0]["parts"]) == signs[0]["n"] == 298 and sum(signs[2]["wide"]) == signs[2]["n"] == 11_998
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_jaccard_texts_that_share_an_id(spark):
    from maskwright.llm.jaccard import jaccard_components

    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, "c " * 20)]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5, 78), (5, 5, 78), (7, 5, 79), (8, 5, 79), (9, 9, 1)]


def test_model_beats_counts_on_small_corpora(spark):
    """Held-out text is likelier to the trained model than to word counts, on the least table too."""
    import os

    from maskwright.llm.lm import lm_scores, passes_for, words_for

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    rows = [r for r in lm_scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect() if r.held_out]
    model, base, n = (sum(getattr(r, c) for r in rows) for c in ("score", "base_score", "n_tokens"))
    print("held out:", model / n, base / n)
    assert model > base
    assert (words_for(10**6), words_for(10**10), words_for(10**14)) == (2000, 15000, 65536) and (passes_for(0), passes_for(500_000), passes_for(10**9)) == (16, 2, 1)
