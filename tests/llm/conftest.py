"""A small set of tables with the hard cases: nulls, empty and long texts, ties, copies and clashing column names."""

import random

import pytest

WORDS = [a + b for a in "ka lo mi nu re so ti va ze bo".split() for b in ("n", "r", "s", "la", "ti", "mo", "é", "ß", "X")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture_texts():
    rng = random.Random(7)
    base = prose(rng, 300)
    passage = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", "Two words", "the same the same", base, base, base.upper(), base]
    for k in range(12):
        w = base.split()
        for _ in range(k % 4 + 1):
            w[rng.randrange(len(w))] = f"edit{k}{rng.randrange(9)}"
        texts.append(" ".join(w))
    for k in range(10):
        texts.append(prose(rng, 20 + 5 * k) + "\n" + passage + "\n" + prose(rng, 30))
    texts += ["a" * 400, "a" * 300 + "b" * 200, "ab" * 150, prose(rng, 20000), "line one here\n" * 12, "x\x1cy\x85z \x0b w\x0cq <|endoftext|> İ é'S 12"]
    texts += [prose(rng, 9), "Released under the MIT License.\n" + prose(rng, 15), "🙂 " * 30 + "日本語 " * 30, "# $ % & | < > * " * 20]
    return texts + [prose(rng, 40 + k) for k in range(20)]


@pytest.fixture(scope="session")
def texts():
    return dict(enumerate(fixture_texts(), start=3))


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, texts):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), -i, "x", i, i) for i, t in texts.items()]
    # size, kept, block and rep clash with names that operators use inside
    cols = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, block long, rep long"
    spark.createDataFrame(rows, cols).repartition(4).write.parquet(f"{d}/documents.parquet")
    rng = random.Random(3)
    vectors = [(k, [rng.gauss(0, 0.2) for _ in range(16)]) for k in range(200)]
    vectors += [(200, vectors[0][1]), (201, vectors[0][1]), (202, None), (203, [None] * 16), (204, [float("nan")] * 16), (205, [float("inf")] * 16), (220, [0.5] * 16)]
    vectors += [(221 + k, [x * (1 + 0.02 * k) + 0.002 * ((k + j) % 3) for j, x in enumerate(vectors[k % 4][1])]) for k in range(20)]
    spark.createDataFrame([(i, v, 0, i) for i, v in vectors], "vec_id long, embedding array<float>, label int, score long").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    page = "<html>" + "copy " * 60
    pages = [(k, f"http://h/{k}", page if k % 3 == 0 else f"<p>{k}</p>" + "é" * k) for k in range(90)] + [(90, None, None), (91, "u", ""), (92, "u", "short"), (93, "u\r\nX-Page-ID: 7", "short"), (94, "u", page)]
    spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{d}/pages.parquet")
    turns = [(c, t, rng.choice(("user", "assistant", "system", None, "tool")), rng.choice(("Yes.", "No", "", None, f"q{c}?")), "b") for c in [None, *range(60)] for t in [None, *range(c % 6 if c else 3)]]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, body string").repartition(3).write.parquet(f"{d}/conversations.parquet")
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(9)), "x") for k in range(12)] + [(12, None, "x"), (13, "", "x"), (14, "nowhere at all", "x"), (3, "kan lor", "x"), (None, "kan", "x")]
    spark.createDataFrame(items, "item_id long, text string, score string").write.parquet(f"{d}/benchmark.parquet")
    more = (("conversations", "conv_id long, turn long, role string, text string"), ("benchmark", "item_id long, text string"))
    for name, schema in (*more, ("documents", cols), ("embeddings", "vec_id long, embedding array<float>, label int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/none/{name}.parquet")
    return d
