"""Archives put together by tasks, and what a download is answered."""

import random
import struct
import zipfile

from maskwright.sources import archives as Z
from maskwright.sources import files as S

FILES = "job_id string, seq long, name string, content binary"


def test_archives_by_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [("big", k, f"f{k}.bin", rng.randbytes(200_000 + k)) for k in range(50)]
    rows += [("a", 1, "é [1].txt", b"x" * 5000), ("a", 0, "same", b"0"), ("a", 2, "same", b""), ("a", 3, None, None), (None, 0, "n", b"null job")]
    made = Z.write_archives(spark.createDataFrame(rows, FILES).repartition(7), f"file://{tmp_path}/z")
    by_job = {r["job_id"]: r for r in made.collect()}
    assert {k: r["members"] for k, r in by_job.items()} == {"big": 50, "a": 4, None: 1}
    for job, r in by_job.items():
        path = r["path"].removeprefix("file://")
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            want = [(n or "document", c or b"") for j, s, n, c in sorted((x for x in rows if x[0] == job), key=lambda x: x[1])]
            assert [(i.filename, z.read(i)) for i in z.infolist()] == want
        assert (tmp_path / path).stat().st_size == r["bytes"]
    back = sorted((str(r["job_id"]), r["name"], bytes(r["content"])) for r in Z.archive_members(made).collect())
    assert back == sorted((str(j), n or "document", c or b"") for j, _, n, c in rows)


def test_no_files_no_archives(spark, tmp_path):
    made = Z.write_archives(spark.createDataFrame([], FILES), f"file://{tmp_path}/z")
    assert made.count() == 0 and Z.archive_members(made).count() == 0


def test_numbers_beyond_four_gigabytes(tmp_path):
    """The 64-bit records, read by the standard library: a member behind 5 GB of a sparse file."""
    at, name = 5 << 30, b"far"
    path = tmp_path / "far.zip"
    with open(path, "wb") as f:
        f.seek(at)
        f.write(Z.local_header(name, 0, 2, 0) + b"\x03\x00")
        entry = Z.central_header(name, 0, 2, 0, at)
        start = f.tell()
        f.write(entry + Z.end_records(1, len(entry), start))
    with zipfile.ZipFile(path) as z:
        assert z.infolist()[0].header_offset == at and z.read("far") == b""
    assert struct.unpack("<I", Z.end_records(70_000, 10, 10)[:4])[0] == Z.END64 and len(Z.end_records(3, 10, 10)) == 22


def test_damaged_files_have_a_row(spark):
    good = b"PK\x05\x06" + bytes(18)
    rows = [("bad", "docx", b"no package"), ("none", "docx", None), ("text", None, b"no package"), ("hollow", "pptx", good)]
    files = spark.createDataFrame(rows, "doc_id string, file_type string, content binary")
    errors = {r["doc_id"]: r["error"] for r in S.unreadable(files).collect()}
    assert {"bad", "none"} <= set(errors) and "text" not in errors and errors["bad"].startswith("BadZipFile")
    assert S.text_blocks(files).count() == 0 and S.images(files).count() == 0


def test_download_answers(spark):
    jobs = spark.createDataFrame([("0123456789", "completed", "p"), ("run", "running", None), ("lost", "completed", None), ("odd", None, "p")], "job_id string, status string, path string")
    asked = spark.createDataFrame([(j,) for j in ("0123456789", "run", "lost", "odd", "none", None)], "job_id string")
    got = {r["job_id"]: (r["code"], r["reason"], r["file_name"], r["path"]) for r in Z.download(asked, jobs).collect()}
    assert got == {
        "0123456789": (200, None, "anonymise_01234567.zip", "p"),
        "run": (400, "job not finished: running", None, None),
        "lost": (500, "archive missing", None, None),
        "odd": (400, "job not finished: unknown", None, None),
        "none": (404, "job unknown or expired", None, None),
        None: (404, "job unknown or expired", None, None),
    }
