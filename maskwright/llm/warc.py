"""Content-addressed web archive: payloads stored once by SHA-256, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, save

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
CRLF = "\r\n"
#: A digest of more pages is split over tasks, ``HOT`` pages for each; at most ``MOST_HOT`` digests are, the commonest, so a digest left whole has at most
#: that share of all pages.
HOT, MOST_HOT = 1_000, 10_000


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _lines(*pairs) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in pairs])


def _record_id(page_id: Column) -> Column:
    """A stable urn:uuid made of the digest of the page id."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _hot(firsts: DataFrame) -> DataFrame:
    """The commonest digests and over how many tasks each is split: at most ``MOST_HOT`` rows, small enough for every task."""
    top = firsts.filter(F.col("copies") > HOT).orderBy(F.desc("copies"), "payload_digest").limit(MOST_HOT)
    return F.broadcast(top.select("payload_digest", F.col("first_id").alias("_hot_first"), F.ceil(F.col("copies") / HOT).alias("parts")))


def _sized(pages: DataFrame) -> DataFrame:
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    meta = pages.select("page_id", url.alias("url"), _payload(F.col("html")).alias("_p"))
    return meta.select("page_id", "url", F.sha2("_p", 256).alias("payload_digest"), F.octet_length("_p").cast("long").alias("n"))


def repeated_digests(pages: DataFrame) -> DataFrame:
    """(payload_digest, first_id, copies, n) of the payloads of several pages, counted with partial sums."""
    counted = _sized(pages).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    return counted.filter("copies > 1")


def record_headers(pages: DataFrame, firsts: DataFrame, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, part, header): the exact header bytes of one WARC/1.1 record for each page.

    Pages of the commonest digests find them in a small table that every task has; the others meet theirs by hash. ``part`` spreads a common digest's pages.
    """
    meta = _sized(pages).join(_hot(firsts), "payload_digest", "left")
    # pages already served go anywhere, not to one task
    key = F.when(F.col("parts").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rest = firsts.select(F.col("payload_digest").alias("_key"), F.col("first_id").alias("_rest_first"))
    meta = meta.withColumn("_key", key).join(rest, "_key", "left").withColumns({
        "first_id": F.when(F.col("n") >= least_bytes, F.coalesce("_hot_first", "_rest_first")),
        "part": F.coalesce(F.pmod(F.xxhash64("page_id", "url"), "parts"), F.lit(0)).cast("long"),
    })
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    common = [
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("X-Payload-Length", F.col("n")),
    ]
    response = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}"), _lines(*common, ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n"))), F.lit(CRLF))
    refers = [
        ("WARC-Refers-To", _record_id(F.col("first_id"))),
        ("X-Refers-To-Page-ID", F.col("first_id")),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Length", F.lit(0)),
    ]
    revisited = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}"), _lines(*common, *refers), F.lit(CRLF))
    return meta.select("page_id", "payload_digest", "part", F.encode(F.when(revisit, revisited).otherwise(response), "UTF-8").alias("header"))


def write_archive(pages: DataFrame, where: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """Write ``where``/headers (page_id, payload_digest, part, header) and ``where``/payloads (digest, parts, payload).

    ``payloads`` has each distinct payload once. Copies within a task meet before the shuffle. The
    stored digest is computed from the stored bytes. A repeated page row gives a repeated record of the same id (of the first page: again a response);
    pages without html have an empty payload, pages without an id are never the first, and copies of theirs alone are all responses. Pages of any length
    are stored whole; an empty table gives empty archives; columns other than page_id, url and html are not stored.
    """
    firsts = save(repeated_digests(pages), where + "/repeated")
    save(record_headers(pages, firsts, date, least_bytes), where + "/headers")
    payload = pages.select(_payload(F.col("html")).alias("payload"))
    unique = payload.groupBy(F.sha2("payload", 256).alias("payload_digest")).agg(F.first("payload").alias("payload"))
    parts = F.coalesce("parts", F.lit(1)).cast("long").alias("parts")
    save(unique.join(_hot(firsts), "payload_digest", "left").select(F.col("payload_digest").alias("digest"), parts, "payload"), where + "/payloads")
    remove(pages.sparkSession, where + "/repeated")


def read_archive(spark, where: str) -> DataFrame:
    """Records rebuilt by joining headers to payloads: header fields, the verified payload and ``record``.

    ``record`` has the bytes of the original WARC record: header, block (empty for revisits), two
    line ends. A response's ``payload`` is cut out of its record by the header's Content-Length; a revisit's is the one it refers to. A payload that doesn't
    hash to its digest, and a header whose payload is missing, fail the read. A common payload is sent once for each part of its pages.
    """
    headers = spark.read.parquet(where + "/headers")
    payloads = spark.read.parquet(where + "/payloads")
    checked = payloads.select(
        "digest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("_stored"),
    )
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract("_h", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(_h, '\\r\\n{name}: ([^\\r\\n]*)\\r\\n', 1), '') as bigint)")
    parsed = headers.select("header", "part", text.alias("_h")).select(
        "header",
        "part",
        number("X-Page-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        number("X-Payload-Length").alias("_n"),
        number("Content-Length").alias("_content"),
        field("WARC-Target-URI").alias("url"),
        number("X-Refers-To-Page-ID").alias("refers_to"),
    )
    block = F.when(F.col("record_type") == "response", F.col("_stored")).otherwise(F.lit(b""))
    missing = F.raise_error(F.concat(F.lit("no whole payload for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    rebuilt = parsed.join(checked, ["digest", "part"], "left").withColumn("record", F.when(F.octet_length("_stored") == F.col("_n"), F.concat("header", block, F.lit(b"\r\n\r\n"))).otherwise(missing))
    body = F.substring(F.col("record"), F.octet_length("header") + 1, F.col("_content").cast("int"))
    payload = F.when(F.col("record_type") == "response", body).otherwise(F.when(F.octet_length("record") == F.octet_length("header") + 4, F.col("_stored")))
    return rebuilt.select("page_id", "url", "record_type", "refers_to", "digest", payload.alias("payload"), "record")
