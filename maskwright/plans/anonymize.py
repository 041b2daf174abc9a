"""Whole plans: anonymise, preview and restore texts and Office files."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masking import mask_exact, unmask_pairs
from ..functions.text import emails, exploded, extension, firsts, keep_title, let, rename_stem, safe_name, stem, trim_py
from ..operators.entities import AUTO_CONFIRM, ENTRY, Detector, line_names, pairs_in_row, with_detections, with_entries, with_spans
from ..operators.matching import preview_rows, with_hits
from ..sources import ooxml

PRESENT = "array<struct<ord:long,category:string,term:string>>"
FIND = "struct<entity:string,category:string,confidence:double>"


def merged_terms(base: dict[str, list[str]] | None, extra: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """Lists of both by category, the base's first, each term once; empty lists of the second add no category."""
    out = {k: list(dict.fromkeys(v or [])) for k, v in (base or {}).items()}
    for k, v in (extra or {}).items():
        if v:
            out[k] = list(dict.fromkeys([*out.get(k, []), *v]))
    return out


def terms_table(spark: SparkSession, terms: dict[str, list[str]] | DataFrame | None) -> DataFrame:
    """(category, term, seq) of a dictionary; a table of (category, term, seq) stays as it is."""
    if isinstance(terms, DataFrame):
        return terms
    rows = [(c, t) for c, ts in (terms or {}).items() for t in ts or [] if t]
    return spark.createDataFrame([(c, t, k) for k, (c, t) in enumerate(rows)], "category string, term string, seq long")


def finds(found: Column, category: Column | None = None) -> Column:
    """Finds without a confidence, as a mapping takes them."""
    kind = (lambda x: x["category"]) if category is None else (lambda x: category)
    return F.transform(found, lambda x: F.struct(x["entity"].alias("entity"), kind(x).alias("category"), F.lit(None).cast("double").alias("confidence")))


def with_masked(df: DataFrame, text: str, out: str = "masked", mapping: str = "mapping") -> DataFrame:
    """The rows with ``out``: their text with the pairs of their own mapping."""
    return df.withColumn("_pairs", pairs_in_row(F.col(mapping))).withColumn(out, mask_exact(F.col(text), F.col("_pairs"))).drop("_pairs")


def mask_emails(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """The rows with ``out``: their text with its addresses numbered and masked."""
    found = df.withColumn("_none", F.array().cast(PRESENT)).withColumn("_finds", finds(emails(F.coalesce(F.col(text), F.lit(""))), F.lit("mails")))
    return with_masked(with_entries(found, "_none", "_finds", "_entries"), text, out, "_entries").drop("_none", "_finds", "_entries")


def with_mapping(df: DataFrame, body: str, terms=None, detector: Detector = line_names, confirmed: str | None = None, auto_confirm_all: bool = True, strict_presence: bool = True) -> DataFrame:
    """The rows with ``mapping``, array of ``ENTRY``: what is sensitive in the text ``body``, merged and numbered, each row on its own.

    The sources are columns: dictionary terms that the text has, by one automaton; the detector's finds, without those terms; addresses; and ``confirmed``, a column of
    finds. The first to claim a normal form has it. Nothing is shuffled: rows pass an Arrow function for the dictionary and one for the detector, all else are expressions.
    ``strict_presence`` looks for dictionary terms with underscores joining words; without it an underscore parts them, as replacement does.
    """
    spark = df.sparkSession
    words = with_hits(df, terms_table(spark, terms), body, strict_presence) if terms is not None else df.withColumn("_hits", F.array().cast("array<struct<ord:long,category:string,term:string>>"))
    here = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: F.struct(h["ord"].alias("ord"), h["category"].alias("category"), h["term"].alias("term")))))
    found = with_spans(words.withColumn("_present", here).drop("_hits"), body, detector, "_spans")
    least = 0.0 if auto_confirm_all else AUTO_CONFIRM
    found = with_detections(found.withColumn("_known", F.transform("_present", lambda p: p["term"])), "_spans", "_known", "_sure")
    sure = F.filter("_sure", lambda d: d["confidence"] >= least)
    more = [F.coalesce(F.col(confirmed), F.array().cast(f"array<{FIND}>"))] if confirmed else []
    every = F.concat(finds(sure), finds(emails(F.coalesce(F.col(body), F.lit(""))), F.lit("mails")), *more)
    return with_entries(found.withColumn("_finds", every), "_present", "_finds").drop("_present", "_known", "_spans", "_sure", "_finds")


def masked_name(name: Column, pairs: Column) -> Column:
    return F.concat(mask_exact(rename_stem(name), pairs), extension(name))


def anonymize_texts(docs: DataFrame, terms=None, detector: Detector = line_names, auto_confirm_all: bool = True, strict_presence: bool = True) -> DataFrame:
    """(doc_id, filename, text, masked, masked_name, mapping) of (doc_id, filename, text).

    A document is a row from beginning to end: no shuffle at any size. Null texts and names stay null; repeated rows are masked each.
    """
    body = docs.select(F.col("doc_id").cast("long"), F.col("filename").cast("string"), F.col("text").cast("string"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), trim_py), lambda x: x != "")
    head = F.filter(F.array(F.coalesce(stem(F.col("filename")), F.lit(""))), lambda x: x != "")
    planned = with_mapping(body.withColumn("_body", F.array_join(F.concat(lines, head), "\n")), "_body", terms, detector, None, auto_confirm_all, strict_presence)
    paired = planned.withColumn("_pairs", pairs_in_row(F.col("mapping")))
    return paired.select("doc_id", "filename", "text", mask_exact(F.col("text"), F.col("_pairs")).alias("masked"), masked_name(F.col("filename"), F.col("_pairs")).alias("masked_name"), "mapping")


def mapping_rows(masked: DataFrame) -> DataFrame:
    """(doc_id, seq, original, placeholder, type, source, confidence)."""
    return exploded(masked, ("doc_id",), "mapping", pos="seq").select("doc_id", "seq", "e.*")


def back_pairs(mapping: Column) -> Column:
    """Pairs for the way back: first original of each placeholder, longest placeholder first, ties in mapping order."""
    kept = let(F.filter(mapping, lambda e: F.coalesce(e["placeholder"], F.lit("")) != ""), lambda m: firsts(m, lambda e: e["placeholder"]))
    keyed = F.transform(kept, lambda e, i: F.struct((-F.length(e["placeholder"])).alias("n"), i.alias("i"), e["placeholder"].alias("original"), e["original"].alias("placeholder")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["original"].alias("original"), x["placeholder"].alias("placeholder")))


def restore_texts(masked: DataFrame, text: str = "masked", mapping: str = "mapping") -> DataFrame:
    """Add ``restored``: placeholders turned into their first originals."""
    return masked.withColumn("_back", back_pairs(F.col(mapping))).withColumn("restored", mask_exact(F.col(text), F.col("_back"))).drop("_back")


def restore_name(name: Column, mapping: Column) -> Column:
    """A file name without its prefix, bracketed and round placeholders turned back, the longest first, literally."""
    bare = F.regexp_replace(name, "^anonymise_", "")
    return F.aggregate(
        back_pairs(mapping), bare, lambda acc, p: F.replace(F.replace(acc, p["original"], p["placeholder"]), F.translate(p["original"], "[]", "()"), p["placeholder"])
    )


def output_names(df: DataFrame, keep: bool = False) -> DataFrame:
    """Add document_name and mapping_name of (filename, masked_name)."""
    name = keep_title(F.col("filename")) if keep else safe_name(F.concat(F.lit("anonymise_"), "masked_name"))
    return df.withColumn("document_name", name).withColumn("mapping_name", F.concat(F.lit("mapping_"), stem(F.col("document_name")), F.lit(".json")))


_PARSED = pa.schema([("doc_id", pa.string()), ("filename", pa.string()), ("file_type", pa.string()), ("content", pa.binary()), ("body", pa.string()), ("alts", pa.list_(pa.string())), ("error", pa.string())])
_PARSED_SQL = "doc_id string, filename string, file_type string, content binary, body string, alts array<string>, error string"
_REWRITTEN = pa.schema([("doc_id", pa.string()), ("filename", pa.string()), ("file_type", pa.string()), ("content", pa.binary()), ("masked_name", pa.string()), ("mapping", pa.list_(pa.struct([("original", pa.string()), ("placeholder", pa.string()), ("type", pa.string()), ("source", pa.string()), ("confidence", pa.int32())]))), ("status", pa.string()), ("error", pa.string())])
_REWRITTEN_SQL = f"doc_id string, filename string, file_type string, content binary, masked_name string, mapping array<{ENTRY}>, status string, error string"


def _fault(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def anonymize_files(files: DataFrame, terms=None, detector: Detector = line_names, scrub_images: bool = False) -> DataFrame:
    """Office files anonymised, each on its own: a bad file has status error, another type skipped, and neither stops the rest.

    Packages are parsed to text and alternative texts, planned as any text is, and rewritten with their pairs; three steps over the same rows.
    """

    def parse(batches):
        for batch in batches:
            out = []
            for doc_id, name, kind, content in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                body, alts, error = None, [], None
                if kind is not None:
                    try:
                        pkg = ooxml.Package(content.as_py())
                        body = "\n".join([t for _, t in ooxml.text_blocks(pkg)] + [x for x in [(name or "").rsplit(".", 1)[0]] if x])
                        alts = list(dict.fromkeys(a for a, _ in ooxml.alt_texts(pkg)))
                    except Exception as e:  # a file's fault stays with the file
                        error = _fault(e)
                out.append((doc_id, name, kind, content.as_py() if kind is not None and error is None else None, body, alts, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out), _PARSED)], schema=_PARSED)

    def rewrite(batches):
        for batch in batches:
            out = []
            for doc_id, name, kind, content, shown, mapping, pairs, alts, error in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), *(batch.column(k).to_pylist() for k in range(4, 9))):
                data, status = content.as_py(), "skipped" if kind is None else "error" if error else "done"
                if status == "done":
                    try:
                        marks = {a["original"]: a["placeholder"] for a in alts}
                        if pairs or marks:
                            data = ooxml.rewrite(ooxml.Package(data), [(p["original"], p["placeholder"]) for p in pairs], marks)
                        data = ooxml.scrub(data) if scrub_images else data
                    except Exception as e:  # a file's fault stays with the file
                        data, status, error = None, "error", _fault(e)
                fine = status == "done"
                out.append((doc_id, name, kind, data if fine else None, shown if fine else name, mapping if fine else [], status, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out), _REWRITTEN)], schema=_REWRITTEN)

    parsed = files.select(F.col("doc_id").cast("string"), "filename", "file_type", "content").mapInArrow(parse, _PARSED_SQL)
    planned = with_mapping(parsed, "body", terms, detector)
    alts = F.transform("alts", lambda a, i: F.struct(a.alias("original"), F.format_string("[ALT_%d]", i + 1).alias("placeholder"), F.lit("alt").alias("type"), F.lit("alt_text").alias("source"), F.lit(100).alias("confidence")).cast(ENTRY))
    ready = planned.withColumn("_pairs", pairs_in_row(F.col("mapping"))).withColumn("_alts", alts)
    shown = F.coalesce(masked_name(F.col("filename"), F.col("_pairs")), F.col("filename"))
    columns = ("doc_id", "filename", "file_type", "content", shown.alias("shown"), F.concat("mapping", "_alts").alias("mapping"), F.col("_pairs").alias("pairs"), F.col("_alts").alias("alts"), "error")
    return ready.select(*columns).mapInArrow(rewrite, _REWRITTEN_SQL)


def restore_files(files: DataFrame) -> DataFrame:
    """Restore (doc_id, filename, content, mapping) files and names; without placeholders a file stays as it is."""

    @F.pandas_udf(T.BinaryType())
    def back(content: pd.Series, mapping: pd.Series) -> pd.Series:
        pairs = [unmask_pairs(m) for m in mapping]
        return pd.Series([ooxml.rewrite(ooxml.Package(c), p) if p else c for c, p in zip(content, pairs)], dtype=object)

    return files.select("doc_id", restore_name(F.col("filename"), F.col("mapping")).alias("filename"), back("content", "mapping").alias("content"))


def preview(blocks: DataFrame, terms: DataFrame, detections: DataFrame, mails: DataFrame) -> DataFrame:
    """One row per block with highlights, placed and numbered: (doc_id, block_seq, section, text, highlights).

    ``terms`` is (term, category[, seq]); detections and mails are (doc_id, entity, category, confidence). Every highlight is confirmed. Where documents come as rows already, ``preview_documents`` needs no shuffle.
    """
    row = F.struct("block_seq", "section", "text")
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("blocks"))
    found = detections.withColumn("src", F.lit(1)).unionByName(mails.withColumn("src", F.lit(2)))
    find = F.struct("src", "entity", "category", (F.col("confidence") * 100).cast("int").alias("score"))
    own = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(find)).alias("finds"))
    joined = docs.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return preview_rows(joined.select("doc_id", "blocks", F.coalesce("finds", F.array().cast(OWN)).alias("finds")), terms)


OWN = "array<struct<src:int,entity:string,category:string,score:int>>"


def preview_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for (doc_id, text, finds array<struct<src,entity,category,score>>): blocks are the text's lines that aren't blank, and no row leaves its task."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct(i.alias("block_seq"), F.concat(F.lit("Paragraphe "), (i + 1).cast("string")).alias("section"), trim_py(t).alias("text")))
    return preview_rows(docs.select("doc_id", F.filter(lines, lambda b: b["text"] != "").alias("blocks"), "finds"), terms)


def preview_summary(previewed: DataFrame) -> DataFrame:
    return previewed.groupBy("doc_id").agg(F.sum(F.size("highlights")).alias("confirmed"), F.lit(0).cast("long").alias("uncertain"))


def fixed_pairs(spark: SparkSession, terms: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Pairs of a dictionary alone, numbered as for a document that has all of it."""
    rows = terms_table(spark, terms).select(F.struct(F.col("seq").alias("ord"), "category", "term").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    entries = with_entries(rows.withColumn("found", F.array().cast(f"array<{FIND}>")), "p", "found")
    pairs = entries.select(pairs_in_row(F.col("mapping")).alias("pairs")).first()["pairs"]
    return [(p["original"], p["placeholder"]) for p in pairs]
