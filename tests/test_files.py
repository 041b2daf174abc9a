"""Office packages, images, clients, mappings and batch jobs."""

import io
import json
import zipfile
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from maskwright.operators import images as I
from maskwright.plans import anonymize as A
from maskwright.sources import files as S
from maskwright.sources import ooxml as O
from maskwright.streaming import batch as B

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:w14="urn:w14" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Note LaPoste</dc:title><dc:creator>Me</dc:creator><cp:keywords>k</cp:keywords></cp:coreProperties>'


def rels(*items):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


def pack(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return buffer.getvalue()


def para(*runs, first="", last=""):
    return "<a:p>" + first + "".join(f"<a:r><a:rPr b='{k}'/><a:t>{t}</a:t></a:r>" for k, t in enumerate(runs)) + last + "</a:p>"


def pptx(cells=(("Hélène", "ETTAHAR"), ("Pierre CAYET", "Emmanuelle MAILLOT")), body=""):
    rows = "".join(f"<a:tr><a:tc><a:txBody>{''.join(para(x) for x in c)}</a:txBody></a:tc></a:tr>" for c in cells)
    shape = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Titre" descr=" logo LaPoste "/></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    table = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="T"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="4" name="I"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId1"/></p:blipFill></p:pic>'
    return pack({
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f"<p:sld {NS}><p:cSld><p:spTree>{shape}<p:grpSp>{table}</p:grpSp>{pic}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId1", "image", "../media/i.png"), ("rId2", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/notesSlides/n1.xml": f'<p:notes {NS}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="1" name="n"/><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{para("note LaPoste")}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>',
        "ppt/media/i.png": O.flat_png(40, 30, (9, 9, 9)),
        "docProps/core.xml": CORE,
    })


def docx():
    p = lambda *runs: "<w:p>" + "".join(f'<w:r><w:rPr><w:b w:val="{k}"/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>' for k, t in enumerate(runs)) + "</w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('Ann')}{p(' ')}{p('Lee')}</w:tc></w:tr></w:tbl>"
    drawing = '<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="x" descr="Logo"/></wp:inline></w:drawing></w:r></w:p>'
    return pack({
        "word/document.xml": f'<w:document {WNS}><w:body>{p("Chez La", "Poste SA")}{p("")}{p("jean@x.fr")}{table}{drawing}<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr></w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("rId1", "header", "header1.xml")),
        "word/header1.xml": f"<w:hdr {WNS}>{p('LaPoste tête')}</w:hdr>",
        "docProps/core.xml": CORE,
    })


def anonymized(spark, content, name, terms, detector=A.line_names):
    files = spark.createDataFrame([("1", name, name[-4:], bytearray(content))], "doc_id string, filename string, file_type string, content binary")
    r = A.anonymize_files(files, terms, detector).first()
    assert (r.status, r.error) == ("done", None)
    return bytes(r.content), r.masked_name, r.mapping


def test_pptx_round_trip(spark):
    source = pptx()
    out, name, rows = anonymized(spark, source, "matrice.pptx", None)
    text = " ".join(t for _, t in O.text_blocks(O.Package(out)))
    assert len({r["placeholder"] for r in rows if r["source"] == "ai"}) == 4 and name == "matrice.pptx"
    assert not any(n in text for n in ("Hélène", "ETTAHAR", "CAYET", "MAILLOT"))
    back = O.rewrite(O.Package(out), A.unmask_pairs(rows))
    assert [t for _, t in O.text_blocks(O.Package(back))] == [t for _, t in O.text_blocks(O.Package(source))]
    assert O.alt_texts(O.Package(out)) == [("[ALT_1]", "Slide 1")]


def test_paragraph_order():
    body = para("La ", "Direction Juridique", " gère ", "Paris", " et ", "Lille", first="<a:pPr/>", last="<a:endParaRPr/>")
    out = O.rewrite(O.Package(pptx(body=body)), [("Direction Juridique", "[ENTREPRISE_1]"), ("Paris", "[LIEU_2]"), ("Lille", "[LIEU_1]")])
    p = next(O.Package(out).tree("ppt/slides/slide1.xml").iter(f"{O.A}p"))
    tags = [O.local(e.tag) for e in p]
    assert O._draw_text(p) == "La [ENTREPRISE_1] gère [LIEU_2] et [LIEU_1]" and tags[0] == "pPr" and tags[-1] == "endParaRPr" and set(tags[1:-1]) == {"r"}


def test_docx_blocks_and_rewrite(spark):
    pkg = O.Package(docx())
    assert O.text_blocks(pkg) == [("Paragraphe 1", "Chez LaPoste SA"), ("Paragraphe 3", "jean@x.fr"), ("Tableau 1 — Cellule (1,1)", "Ann\nLee"), ("En-tête", "LaPoste tête")]
    out, name, rows = anonymized(spark, docx(), "LaPoste_x.docx", {"entreprises": ["LaPoste"]}, lambda t: [])
    new = O.Package(out)
    assert [t for _, t in O.text_blocks(new)] == ["Chez [ENTREPRISE_1] SA", "[MAIL_1]", "Ann\nLee", "[ENTREPRISE_1] tête"]
    assert name == "LaPoste_x.docx" or name == "[ENTREPRISE_1]_x.docx"
    assert O.alt_texts(new) == [("[ALT_1]", "Corps du document")] and b'xmlns:w14="urn:w14"' in new.parts["word/document.xml"]
    core = new.parts["docProps/core.xml"].decode()
    assert "Note [ENTREPRISE_1]" in core and ">Me<" not in core and ">k<" not in core
    assert {r["source"] for r in rows} == {"project", "ai", "alt_text"}


def test_scrub_and_sizes():
    out = O.Package(O.scrub(pptx()))
    assert O.image_size(out.parts["ppt/media/i.png"]) == (40, 30) and I.decode_png(out.parts["ppt/media/i.png"])[0, 0].tolist() == [220, 220, 220]
    assert O.image_size(O.flat_bmp(7, 5)) == (7, 5) and O.neutral("a.svg", b"").startswith(b"<svg") and O.neutral("a.mp4", b"x") is None
    assert O.image_size(O.neutral("a.emf", b"")) == (200, 200) and O.image_size(O.neutral("x.jpg", b"junk")) == (200, 200)


def test_hashes_and_logos(spark):
    import zlib

    def png(px):
        h, w = px.shape
        raw = b"".join(b"\x00" + bytes(r) for r in px.astype(np.uint8))
        c = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
        return b"\x89PNG\r\n\x1a\n" + c(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x00\x00\x00\x00") + c(b"IDAT", zlib.compress(raw)) + c(b"IEND", b"")

    y, x = np.mgrid[0:64, 0:64]
    a, b = png(128 + 100 * np.sin(x / 9) * np.cos(y / 7)), png(128 + 96 * np.sin(x / 9) * np.cos(y / 7))
    far = png((x * y) % 251)
    ha, hb, hf = map(I.perceptual_hash, (a, b, far))
    diff = lambda p, q: bin(int(p, 16) ^ int(q, 16)).count("1")
    assert diff(ha, hb) <= 8 < diff(ha, hf) and I.perceptual_hash(b"no") is None
    rows = [("d", k, "p", h) for k, h in enumerate((ha, hb, hf))] + [("e", 0, "q", hf)]
    images = spark.createDataFrame(rows, "doc_id string, idx int, project_id string, phash string")
    logos = spark.createDataFrame([("p", ha)], "project_id string, logo_hash string")
    matched = I.match_logos(images, logos)
    got = {(r.doc_id, r.idx): (r.status, r.hash_diff) for r in matched.collect()}
    assert got[("d", 0)] == ("auto_remove", 0) and got[("d", 2)][1] == diff(ha, hf) and got[("e", 0)] == ("review", None)
    edge = spark.createDataFrame([(k,) for k in (8, 9, 18, 19)], "d int").select(I.image_status(F.col("d"), F.lit(True)).alias("s")).collect()
    assert [r.s for r in edge] == ["auto_remove", "review", "review", "keep"]
    assert {r.doc_id: r.auto_removed_count for r in I.image_counts(matched).collect()} == {"d": 2, "e": 0}
    assert I.to_remove(matched, spark.createDataFrame([("e", 0)], "doc_id string, idx int")).count() == 3


def test_folder_to_results(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pptx").write_bytes(pptx())
    (src / "B.DOCX").write_bytes(docx())
    (src / "bad.docx").write_bytes(b"junk")
    (src / "n.txt").write_bytes(b"x")
    files = S.office_files(spark, f"file://{src}")
    assert S.text_blocks(files).count() == 7 and S.alt_texts(files).count() == 2 and S.images(files).first().width == 40
    q = B.watch_folder(spark, f"file://{src}", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", {"entreprises": ["LaPoste"]})
    q.awaitTermination(120)
    res = spark.read.parquet(f"{tmp_path}/out")
    assert {r.filename: r.status for r in res.collect()} == {"a.pptx": "done", "B.DOCX": "done", "bad.docx": "error", "n.txt": "skipped"}
    p = B.job_progress(res.select(F.lit("j").alias("job_id"), "status")).first()
    assert (p.total, p.done, p.errors, p.skipped, p.success, p.percent) == (4, 4, 1, 1, 2, 100)
    back = A.restore_files(res.filter("status = 'done'").select("doc_id", F.col("masked_name").alias("filename"), "content", "mapping"))
    texts = [t for r in back.collect() for _, t in O.text_blocks(O.Package(bytes(r.content)))]
    assert "Chez LaPoste SA" in texts and "note LaPoste" in texts
    out = res.filter("status = 'done'").select(F.lit("j").alias("job_id"), F.length("filename").alias("seq"), F.col("masked_name").alias("name"), "content")
    with zipfile.ZipFile(io.BytesIO(bytes(S.zip_archives(out).first().zip))) as z:
        assert len(z.namelist()) == 2
    assert S.write_files(out, f"file://{tmp_path}/files").count() == 2 and len(list((tmp_path / "files").iterdir())) == 2


def test_projects_and_mappings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "client": "C", "entities": {"personnes": ["x", "y"], "lieux": ["z"]}}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "name": "N", "terms": ["t"], "entities": {"lieux": ["q"]}, "logo_hashes": ["00"]}))
    got = {r.id: r for r in S.read_projects(spark, str(tmp_path)).collect()}
    assert got["a"].name == "C" and got["a"].terms == ["x", "y", "z"] and got["b"].term_count == 1 and got["b"].logo_hashes == ["00"]
    raw = spark.read.schema(S.PROJECT_SCHEMA).option("multiLine", "true").json(str(tmp_path))
    assert {(r.project_id, r.category, r.term) for r in S.project_terms(raw).collect()} == {("a", "personnes", "x"), ("a", "personnes", "y"), ("a", "lieux", "z"), ("b", "autres", "t")}
    clients = spark.createDataFrame([("old", "Old", ["a"], "1")], "id string, name string, terms array<string>, created_at string")
    changes = spark.createDataFrame([(None, " Été SA ", ["b ", "B"], "2"), ("old", "New", None, "2"), (None, " ", ["x"], "2")], clients.schema)
    new = S.upsert_clients(clients, changes)
    assert {(r.id, r.name, tuple(r.terms)) for r in new.collect()} == {("ete-sa", "Été SA", ("b",)), ("old", "New", ())} and S.delete_client(new, "old").count() == 1
    bad = spark.createDataFrame([(1, '{"entities":[{"original":"a","placeholder":"[X_1]"}]}'), (2, "{oops")], "doc_id long, mapping_json string")
    assert {(r.doc_id, r.bad, r.original) for r in S.read_mapping(bad).collect()} == {(1, False, "a"), (2, True, None)}
    p = spark.createDataFrame([('{"x":["a"]}', '[" b ",""]'), ("{", "{")], "m string, e string").select(S.inline_terms(F.col("m"), F.col("e")).alias("p")).collect()
    assert p[0].p.manual == {"x": ["a"]} and p[0].p.extra == ["b"] and p[1].p.extra == []


def test_records_and_names(spark):
    r = S.project_record(spark.createDataFrame([("Été 1", "C", "2024", {"lieux": ["x"]})], "name string, client string, created_at string, entities map<string,array<string>>")).first()
    assert (r.id, r.logo_hashes, r.entities) == ("ete-1", [], {"lieux": ["x"]}) and S.data_root(spark, "/d") == "/d"
    h = S.restore_history(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, ts int")).select(S.restored_name(F.col("doc_id")).alias("n")).collect()
    assert [x.n for x in h] == ["restaure_b", "restaure_a"]


def test_uploads_and_jobs(spark):
    rows = [("j", k, "a.docx" if k < 2 else f"{k}.PPTX", 1) for k in range(60)] + [("j", 99, "x.pdf", 1)]
    got = B.accept_uploads(spark.createDataFrame(rows, "job_id string, seq int, name string, size long")).collect()
    assert len(got) == 50 and min(r.seq for r in got) == 0 and 1 not in {r.seq for r in got}
    jobs = spark.createDataFrame([(1, datetime(2024, 1, 1, 10)), (2, datetime(2024, 1, 1, 11, 30))], "id int, created_at timestamp")
    assert [r.id for r in B.live_jobs(jobs, datetime(2024, 1, 1, 12)).collect()] == [2]
