"""Detection, grouping, merging, numbering and matching."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X

from maskwright.operators import entities as E
from maskwright.operators import matching as M
from maskwright.plans import anonymize as A


def detected(spark, text, detector, known=()):
    df = spark.createDataFrame([(text, list(known))], "text string, known array<string>")
    return E.with_detections(E.with_spans(df, "text", detector), "spans", "known").first()["detections"]


def entries(spark, terms, found):
    present = [(k, c, t) for k, (c, t) in enumerate((c, t) for c, ts in terms.items() for t in ts)]
    df = spark.createDataFrame([(present, found)], f"p {A.PRESENT}, f array<{A.FIND}>")
    r = E.with_entries(df, "p", "f").withColumn("pairs", E.pairs_in_row(F.col("mapping"))).first()
    return [tuple(p) for p in r["pairs"]], r["mapping"]


def groups(spark, lists):
    rows = [([(k, "c", t) for k, t in enumerate(ts)],) for ts in lists]
    df = spark.createDataFrame(rows, f"p {A.PRESENT}").withColumn("i", F.monotonically_increasing_id()).repartition(1)
    return [[g["members"] for g in r["groups"]] for r in E.with_variant_groups(df, "p").orderBy("i").collect()]


def test_names_across_lines(spark):
    text = "Hélène\nETTAHAR\nPierre CAYET\nEmmanuelle MAILLOT"
    found = detected(spark, text, E.line_names)
    assert [d["entity"] for d in found] == ["Hélène", "ETTAHAR", "Pierre CAYET", "Emmanuelle MAILLOT"] and all(text[d["start"] : d["end"]] == d["entity"] for d in found)
    assert detected(spark, "Hélène\nETTAHAR", E.line_names, ["hélène"])[0]["entity"] == "ETTAHAR"


def test_filters_and_overlap(spark):
    def detector(text):
        return [("B-PER", 0, 4, 0.9), ("PER", 0, 11, 0.95), ("MISC", 12, 16, 1.0), ("ORG", 17, 20, 0.9), ("LOC", 21, 26, 0.4), ("ORG", 27, 32, 0.8)]

    text = "Jean Dupont Word DSI Paris lower"
    assert [(d["entity"], d["category"]) for d in detected(spark, text, detector)] == [("Jean Dupont", "personnes")]


def test_detector_is_loaded_once_and_fed_batches(spark, tmp_path):
    class Counting:
        """A model that writes a line when it is loaded and one for each call, and finds all words of four letters."""

        name = "counting"

        def __init__(self, log):
            self.log = log

        def load(self):
            self._told("load")
            return self

        def batch(self, texts):
            self._told(f"batch {len(texts)}")
            return [[("PER", m.start(), m.end(), 0.9) for m in re.finditer(r"\b[A-Z]\w{3}\b", t)] for t in texts]

        def _told(self, what):
            with open(f"{self.log}/{os.getpid()}", "a") as f:
                f.write(what + "\n")

    texts = [None, "", "Abcd efgh"] + ["x" * (40 * k) + " Wxyz\n" + "Para " * 400 + f"\nLast Pear{k}" for k in range(57)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, text string").repartition(8)
    found = E.with_spans(df, "text", Counting(str(tmp_path))).collect()
    for r in found:
        assert sorted(s["start"] for s in r.spans) == [m.start() for m in re.finditer(r"\b[A-Z]\w{3}\b", r.text or "")]
        assert all(r.text[s["start"] : s["end"]] == s["entity"] for s in r.spans)
    logs = [p.read_text().split("\n")[:-1] for p in tmp_path.iterdir()]
    assert logs and all(log.count("load") == 1 for log in logs)
    assert max(int(line.split()[1]) for log in logs for line in log if line.startswith("batch")) > 5


def test_chunks(spark):
    def packed(text):
        out, size, at = [0], 0, 0
        for n in (len(p) + 1 for p in text.split("\n")):
            if size and size + n > 1500:
                out.append(at)
                size = 0
            size, at = size + n, at + n
        spans = list(zip(out, [*out[1:], at]))
        return [(0, len(text))] if len(text) <= 1500 else spans if (text + "\n")[spans[-1][0] :].strip() else spans[:-1]

    long = "b" * 1600
    texts = ["a" * 1500, "a" * 1501, "", "x\n" + long + "\ny\n" + "z" * 1000 + "\n" + "w" * 600, long + "\n" + " " * 1400 + "\n \n", "é" * 1499 + "\n" + "q\n" * 3000]
    texts += ["\n".join("p" * random.Random(k).randrange(400) for k in range(50)) for k in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunk_spans(F.col("t")).alias("c")).collect()
    assert all([tuple(c) for c in r.c] == packed(r.t) for r in rows)


def test_variant_groups(spark):
    lists = [["Dupont", "Jean Dupont", "J. Dupont", "ACME", "La Poste", "LaPoste"], ["diane", "ia"], ["abc", "-"], []]
    assert groups(spark, lists) == [[["Jean Dupont", "J. Dupont", "Dupont"], ["La Poste", "LaPoste"], ["ACME"]], [["diane", "ia"]], [["abc", "-"]], []]


def test_variant_groups_by_rounds(spark):
    """Leaders elected one by one, on random lists."""
    rng = random.Random(4)
    words = ["jean", "Paul", "le", "Roux", "d'or", "x", "de la", "Saint-Paul", "ROUX", "ab"]
    lists = [[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))] for _ in range(60)]
    tight = lambda t: re.sub("[ '-]", "", t.lower())
    both = lambda a, b: a in b or b in a
    near = lambda a, b: both(a.lower(), b.lower()) or both(tight(a), tight(b)) or any(len(w) > 2 for w in set(a.lower().split()) & set(b.lower().split()))
    for got, terms in zip(groups(spark, lists), lists):
        left, want = sorted(dict.fromkeys(terms), key=lambda t: -len(t)), []
        while left:
            want.append([t for t in left if t == left[0] or near(left[0], t)])
            left = [t for t in left if t not in want[-1]]
        assert got == want


def test_merge(spark):
    pairs, rows = entries(spark, {"personnes": ["Jean Dupont", "Dupont"], "autres": ["dupont"], "x": ["Zed"]}, [("Paris", "lieux", None), (" paris", "lieux", None), ("Eve", "personnes", 0.777), ("DUPONT", "personnes", None)])
    assert pairs == [("Jean Dupont", "[PERSONNE_1]"), ("Dupont", "[PERSONNE_1]"), ("Paris", "[LIEU_1]"), ("Zed", "[SENSIBLE_1]"), ("Eve", "[PERSONNE_2]")]
    assert [(r["original"], r["type"], r["source"], r["confidence"]) for r in rows][-2:] == [("Paris", "lieux", "ai", None), ("Eve", "personne", "ai", 77)]
    _, rows = entries(spark, {}, [(x, "personnes", None) for x in ("Hélène", "ETTAHAR", "Pierre CAYET", "Hélène")])
    assert len({r["placeholder"] for r in rows}) == len(rows) == 3
    # a later group of a member that was claimed takes its placeholder and hands it on
    _, rows = entries(spark, {"a": ["Roux"], "b": ["roux vif", "Roux"], "c": ["roux vif", "Kim"]}, [])
    assert [(r["original"], r["placeholder"]) for r in rows] == [("Roux", "[SENSIBLE_1]"), ("roux vif", "[SENSIBLE_1]"), ("Roux", "[SENSIBLE_1]"), ("roux vif", "[SENSIBLE_1]"), ("Kim", "[SENSIBLE_2]")]


def test_column_filters_equal_python(spark):
    rng = random.Random(3)
    names = ["Jean", "jean", "JEAN", "DSI", "ab", "Le Mans", "data", "Zoé\nX", "▁Bob ", "étude", "été", "Ana Li"]
    rows, text = [], ""
    for k in range(60):
        e = rng.choice(names)
        rows.append((k % 4, k, e, rng.choice(["PER", "B-ORG", "MISC", "I-LOC", "XXX"]), rng.randrange(50), 0, rng.choice([0.4, 0.5, 0.9, 0.95])))
    rows = [(*r[:5], r[4] + len(r[2]), r[6]) for r in rows]
    got = E.filter_detections(spark.createDataFrame(rows, "doc_id int, seq int, entity string, label string, start int, end int, confidence double")).collect()
    for doc in range(4):
        mine = [r for r in got if r.doc_id == doc]
        assert len({r.entity.lower() for r in mine}) == len(mine) and not any(a.start < b.end and a.end > b.start for a in mine for b in mine if a is not b)
        assert all(r.confidence >= 0.5 and len(r.entity) > 2 and "\n" not in r.entity for r in mine)
    del text


def test_numbering_and_pairs(spark):
    rows = [(1, 5, "Bob", "personnes"), (1, 1, "Ann", "personnes"), (1, 9, "ann", "personnes"), (1, 3, "Rome", "lieux"), (1, 4, "Thing", "odd"), (2, 0, "Ann", "autres")]
    mapping = E.number_entities(spark.createDataFrame(rows, "doc_id int, seq int, entity string, category string"))
    assert {(r.doc_id, r.original, r.placeholder) for r in mapping.collect()} == {(1, "Ann", "[PERSONNE_1]"), (1, "Bob", "[PERSONNE_2]"), (1, "Rome", "[LIEU_1]"), (1, "Thing", "[SENSIBLE_1]"), (2, "Ann", "[SENSIBLE_1]")}
    pairs = {r.doc_id: [tuple(p) for p in r.pairs] for r in E.pairs_of(mapping).collect()}
    assert [p[0] for p in pairs[1]] == ["Thing", "Rome", "Ann", "Bob"]


def test_sanitise_and_seed(spark):
    rows = [("personnes", k, t) for k, t in enumerate(["Bob", "Robert", "robert ", "A.B", "IBM", "É. Z", "Bo B", "x"])]
    got = [r.term for r in E.sanitize_terms(spark.createDataFrame(rows, "category string, seq int, term string")).orderBy("seq").collect()]
    assert got == ["Robert", "Bo B"]
    forms = spark.createDataFrame([(1, " Acme ", "Sub One, ", "Marie Curie")], "form_id int, client string, subsidiaries string, contacts string")
    assert {(r.category, r.term) for r in E.seed_terms(forms).collect()} == {("entreprises", "Acme"), ("entreprises", "Sub One"), ("personnes", "Marie Curie"), ("personnes", "CURIE Marie"), ("personnes", "M. Curie")}


def test_presence_quirk_and_joins(spark):
    docs = spark.createDataFrame([(1, "Synthese_LaPoste_mois"), (2, "la LaPoste!"), (3, None), (4, "a - b")], "doc_id long, text string")
    terms = spark.createDataFrame([("LaPoste", "autres"), ("-", "autres")], "term string, category string")
    assert {(r.doc_id, r.term) for r in M.present_terms(docs, terms).collect()} == {(2, "LaPoste"), (4, "-")}
    assert M.present_terms(docs.limit(0), terms).count() == 0 and M.present_terms(docs, terms.limit(0)).count() == 0
    blocks = docs.withColumn("block_seq", F.lit(0))
    assert [(r.doc_id, r.start, r.end) for r in M.term_highlights(blocks, terms.limit(1)).collect()] == [(2, 3, 10)]


def test_texts_round_trip(spark):
    rows = [(1, "synthese_LaPoste.docx", "Bonjour LaPoste et jean@x.fr\nHélène\nPaul Durand"), (2, "x.docx", None), (3, None, ""), (4, "rien.docx", "rien ici")]
    docs = spark.createDataFrame(rows, "doc_id long, filename string, text string")
    out = A.restore_texts(A.anonymize_texts(docs, {"entreprises": ["LaPoste"]})).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].masked == "Bonjour [ENTREPRISE_1] et [MAIL_1]\n[PERSONNE_1]\n[PERSONNE_2]" and by[1].masked_name == "synthese_[ENTREPRISE_1].docx"
    assert by[1].restored == rows[0][2] and by[2].masked is None and by[4].masked == "rien ici"
    names = A.anonymize_texts(docs, {"entreprises": ["LaPoste"]}).filter("doc_id = 1")
    assert names.select(A.restore_name(F.lit("anonymise_Synthese_(ENTREPRISE_1) [MAIL_1].docx"), F.col("mapping")).alias("n")).first().n == "Synthese_LaPoste jean@x.fr.docx"
    assert A.output_names(names).first().document_name == "anonymise_synthese_(ENTREPRISE_1).docx"


def test_preview(spark):
    blocks = spark.createDataFrame([(1, 0, "P1", "La Poste et Paul à La Poste"), (1, 1, "P2", "rien")], "doc_id long, block_seq int, section string, text string")
    terms = spark.createDataFrame([("Poste", "autres"), ("La Poste", "entreprises")], "term string, category string")
    found = spark.createDataFrame([(1, "Paul", "personnes", 0.9), (1, "Poste", "lieux", 0.9)], "doc_id long, entity string, category string, confidence double")
    none = found.limit(0)
    r = A.preview(blocks, terms, found, none).collect()
    assert len(r) == 1 and [(h.start, h.entity, h.placeholder) for h in r[0].highlights] == [(0, "La Poste", "[ENTREPRISE_1]"), (12, "Paul", "[PERSONNE_1]"), (19, "La Poste", "[ENTREPRISE_1]")]
    assert A.preview_summary(A.preview(blocks, terms, found, none)).first().confirmed == 3


@pytest.mark.parametrize("letters", [None, 40])
def test_many_terms_in_one_pass(spark, monkeypatch, letters):
    """All places of all terms, as each term's own pattern has them, with repeated and null ids, in one automaton or several."""
    if letters:
        monkeypatch.setattr(M, "MOST_LETTERS", letters)
    rng = random.Random(6)
    words = ["ab", "AB", "Ab cd", "cd", "é", "É", "x_y", "y", "-", "a.b", "İx", "straße", "ſ"]
    terms = [(w, "c") for w in dict.fromkeys([*words, "ab cd ab", "cd-x", "S"])]
    docs = [(rng.choice([None, 1, 2]), "".join(rng.choice(words) + rng.choice([" ", "", "-", "_", "."]) for _ in range(rng.randrange(14)))) for _ in range(120)]
    docs += [(7, "ab cd ab cd ab"), (7, "ab cd ab cd ab"), (None, None), (3, "")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, block_seq int").repartition(3)
    got = M.term_highlights(df, spark.createDataFrame(terms, "term string, category string")).collect()
    same = lambda t: re.compile(rf"(?<!\\w){re.escape(M.folded(t))}(?!\\w)".replace("\\\\", "\\"))
    want = [(i, m.start(), m.end(), t[m.start() : m.end()], w) for i, t in docs if t for w, _ in terms for m in same(w).finditer(M.folded(t))]
    assert sorted((r.doc_id, r.start, r.end, r.entity, r.source_entity) for r in got if r.doc_id) == sorted(x for x in want if x[0])
    assert len(got) == len(want) and len(want) > 200


def test_a_long_dictionary(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("term"), "id").alias("term"), F.lit("c").alias("category"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a TERM"), F.col("id") * 7, F.lit(" term1x, term99999.")).alias("text"))
    got = M.present_terms(docs, terms)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.term) for r in got.collect()) == sorted(x for k in range(300) for x in ((k, f"term{7 * k}"), (k, "term99999")))


def test_first_places():
    text = "abcabcd" * 3
    few, many = ["cd", "abc", "x"], ["cd", "abc", "x", "d", "bcd", "a", "ca", "abcabcd", "abc", "q", ""]
    assert sorted(M.first_places(text, few)) == [(0, 1), (5, 0)]
    assert sorted(M.first_places(text, many)) == sorted((text.find(p), k) for k, p in enumerate(many) if p and p in text)


def test_known_terms_and_overlaps(spark):
    rows = [(1, 0, "Ann Lee", "PER", 0, 7, 0.9), (1, 1, "Lee Corp", "ORG", 4, 12, 0.95), (1, 2, "ann lee", "PER", 50, 57, 0.7), (1, 3, "Rome", "LOC", 20, 24, 0.9), (2, 0, "Rome", "LOC", 0, 4, 0.8)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, entity string, label string, start int, end int, confidence double")
    known = spark.createDataFrame([(1, "ROME")], "doc_id int, term string")
    assert sorted((r.doc_id, r.entity) for r in E.filter_detections(df, known).collect()) == [(1, "Lee Corp"), (2, "Rome")]
    assert sorted((r.doc_id, r.entity) for r in E.filter_detections(df, known.select("term")).collect()) == [(1, "Lee Corp")]


def test_fixed_pairs_and_merged_terms(spark):
    assert A.fixed_pairs(spark, {"lieux": ["Rome", "La Rochelle"], "autres": ["x"]}) == [("La Rochelle", "[LIEU_1]"), ("Rome", "[LIEU_2]"), ("x", "[SENSIBLE_1]")]
    assert A.merged_terms({"a": ["x", "y", "x"]}, {"a": ["y", "z"], "b": [], "c": ["w"]}) == {"a": ["x", "y", "z"], "c": ["w"]}


def test_plan_with_confirmed_finds(spark):
    """Sources in order: dictionary, detector, addresses, confirmed; confidence under the limit is left out; repeated rows are planned each."""
    detector = lambda t: [("PER", t.find("Zoé"), t.find("Zoé") + 3, 0.6), ("ORG", t.find("Acme"), t.find("Acme") + 4, 0.9)] if "Zoé" in t else []
    docs = [(1, "Zoé Acme La Poste z@x.fr Kim", [("kim", "personnes", 0.42), ("acme", "lieux", None)]), (1, "Zoé Acme La Poste z@x.fr Kim", None), (None, None, None)]
    df = spark.createDataFrame(docs, f"doc_id long, text string, ok array<{A.FIND}>")
    got = A.with_mapping(df, "text", {"entreprises": ["Poste", "La Poste"]}, detector, "ok", auto_confirm_all=False).collect()
    told = [[(e["original"], e["placeholder"], e["source"], e["confidence"]) for e in r["mapping"]] for r in got]
    first = [("La Poste", "[ENTREPRISE_1]", "project", 100), ("Poste", "[ENTREPRISE_1]", "project", 100), ("Acme", "[ENTREPRISE_2]", "ai", None), ("z@x.fr", "[MAIL_1]", "ai", None)]
    assert told == [[*first, ("kim", "[PERSONNE_1]", "ai", 42)], first, []]


def test_mentions_are_tokens_as_in_sql(spark):
    """Words inside of an address are no mentions, and an address begins where a token does."""
    import duckdb

    from maskwright import queries as Q

    rng, bits = random.Random(7), ["the", "Los", "und", "ist", "İst", "a", "é", "_", "5", ".", "-", "@", "+", " ", " ", "\n", "x.com", "@mail.example.com", "b@c.org", "𝒳", "²", "’"]
    texts = ["ask the.los@mail.example.com or prénom.the@x.com", "a@b.com_und@d.org the a@b.com5the", None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in Q.mentions(df).select("doc_id", "entity", "category").orderBy("doc_id", "seq").collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = c.execute(f"WITH {Q._MENTIONS} SELECT doc_id, tok, category FROM m ORDER BY doc_id, i").fetchall()
    assert [(texts[r[0]], r) for r in got if r not in want] == [] == [(texts[r[0]], r) for r in want if r not in got]
    assert got == want
    assert got[:3] == [(0, "the.los@mail.example.com", "mails"), (0, ".the@x.com", "mails"), (1, "a@b.com", "mails")]


@pytest.mark.parametrize("name", ["mapping_rows", "pair_dedupe", "placeholder_number", "replacement_groups", "replacement_view"])
def test_numbered_mentions_equal_sql(spark, tmp_path, name):
    """Spellings that SQL's lower case makes one are numbered once: İst is ist."""
    import duckdb

    from maskwright import queries as Q

    rng, bits = random.Random(11), ["the", "THE", "Los", "und", "UND", "ist", "IST", "İst", "ıst", "loſ", "é", "_", "5", ".", " ", " ", "\n", "b@c.org", "B@C.org", "𝒳"]
    texts = [None, "", "İst ist und IST"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(Q.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, Q.Q[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_owners_of_shared_and_long_groups(spark):
    """Groups with members claimed before take that claim; long groups that share nothing cost their length."""
    import time

    def model(groups):
        known, of = {}, []
        for g in groups:
            of.append(next((known[m.lower().strip()] for m in g if m.lower().strip() in known), len(of)))
            known.update({m.lower().strip(): of[-1] for m in g})
        return of

    rng = random.Random(3)
    rows = [[[rng.choice(["a", "A", "b ", "c", "d", "E", "f", "g"]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 7))] for _ in range(200)]
    shape = "i int, g array<struct<category:string,members:array<string>>>"
    df = lambda rows: spark.createDataFrame([(i, [("c", g) for g in r]) for i, r in enumerate(rows)], shape)
    assert [r[0] for r in df(rows).orderBy("i").select(E.owners(F.col("g"))).collect()] == [model(r) for r in rows]
    began = time.time()
    assert df([[[f"n{i} x" for i in range(600)], [f"s{i} y" for i in range(600)]]]).select(E.owners(F.col("g")).alias("o")).first()["o"] == [0, 1]
    assert time.time() - began < 20


def test_exploded_works_out_its_array_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "i int, t string")
    rows = X.exploded(df.withColumn("words", F.split("t", " ")), ("i",), "words")
    assert [tuple(r) for r in rows.orderBy("i", "_pos").collect()] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_batches_are_met_in_parts():
    """However many rows a batch has, few of them are Python objects at one time."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 10_000})
    parts = list(M.parts_of(batch))
    assert sum(p.num_rows for p in parts) == 10_000 and max(p.num_rows for p in parts) * 1000 <= M.PART and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_preview_passes_python_once(spark):
    docs = spark.createDataFrame([(1, "Le chat\nJean le chat", [(1, "Jean", "personnes", 90)])], f"doc_id long, text string, finds {A.OWN}")
    rows = A.preview_documents(docs, spark.createDataFrame([("autres", "chat")], "category string, term string"))
    assert [(r["block_seq"], h["entity"], h["placeholder"]) for r in rows.collect() for h in r["highlights"]] == [(0, "chat", "[SENSIBLE_1]"), (1, "Jean", "[PERSONNE_1]"), (1, "chat", "[SENSIBLE_1]")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("letters", [None, 4])
def test_preview_numbers_spellings_as_sql(spark, monkeypatch, letters):
    """İ is lower-cased to i, as in SQL; overlaps, rows without highlights, null ids and dictionaries of several automata are as ever, and no expression goes over a row's hits."""
    if letters:
        monkeypatch.setattr(M, "MOST_LETTERS", letters)
    own = [(1, f"wort{'x' * k}", "entreprises", 87) for k in range(12)]
    docs = spark.createDataFrame([(1, "İst\n\nund ist Und", []), (None, "und wortxxx@b.de", [*own, (2, "wortxxx@b.de", "mails", 100)]), (2, None, None), (3, "rien", [])], f"doc_id long, text string, finds {A.OWN}")
    rows = A.preview_documents(docs, spark.createDataFrame([("lieux", "ist"), ("lieux", "und")], "category string, term string"))
    got = [(r.doc_id, r.block_seq, r.text, [(h.start, h.end, h.entity, h.placeholder) for h in r.highlights]) for r in rows.collect()]
    assert sorted(got, key=lambda r: (r[0] or 0, r[1])) == [
        (None, 0, "und wortxxx@b.de", [(0, 3, "und", "[LIEU_1]"), (4, 16, "wortxxx@b.de", "[MAIL_1]")]),
        (1, 0, "İst", [(0, 3, "İst", "[LIEU_1]")]),
        (1, 2, "und ist Und", [(0, 3, "und", "[LIEU_2]"), (4, 7, "ist", "[LIEU_1]"), (8, 11, "Und", "[LIEU_2]")]),
    ]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sort" not in plan


def test_overlaps_are_chosen_one_by_one():
    """As by trying each in order of length, score, source and place against all kept."""
    rng = random.Random(3)
    for _ in range(300):
        hits = [(rng.randrange(2), s, s + rng.randrange(1, 6), "e", rng.choice("ab"), rng.choice(["c", None]), rng.choice([87, 100]), rng.randrange(3), s, 0) for s in (rng.randrange(20) for _ in range(rng.randrange(12)))]
        kept: list = []
        for h in sorted(hits, key=lambda h: (h[1] - h[2], -h[6], h[7], h[8], h[4], h[5] or "")):
            if all(k[0] != h[0] or k[2] <= h[1] or k[1] >= h[2] for k in kept):
                kept.append(h)
        assert M.chosen(hits) == sorted(kept, key=lambda h: h[:2])
