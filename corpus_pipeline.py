"""From raw documents to packed training sequences: five stages, each a written table.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps,
with the columns of its input, and the last the pieces of the packed sequences.

For all stages: an empty table gives an empty table; texts are taken whole, however long; extra columns, whatever their names, stay with their
row; a null text is empty (the quality rules reject it); a row without an id is a document like others, but its text is never cut by the suffix stage.
Repeated rows: quality rules judge each, the near-copy stage keeps one, the suffix stage cuts all alike, mixing takes each, packing packs each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import save, shared_dir, table
from maskwright.llm.jaccard import jaccard_components
from maskwright.llm.mixing import mix_sources
from maskwright.llm.packing import pack_documents
from maskwright.llm.quality import verdict
from maskwright.llm.suffix import suffix_dedup
from maskwright.llm.tokens import tokenizer_path

#: Near-duplicate stage: words of a shingle and least similarity in percent.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged; a document without words doesn't."""
    return docs.filter(verdict(F.col("text"))["kept"])


def counted(docs: DataFrame) -> DataFrame:
    """n_chars counted anew, where the documents have it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def with_row(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc, row): the rows as one struct each, so that no column of theirs can clash, written once with a number each: ids repeat, so they don't tell rows apart."""
    return save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), shared_dir(spark, "rows"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the least id, unchanged; repeated rows are linked like other copies."""
    rows = with_row(spark, docs)
    groups = jaccard_components(rows.select("row", F.col("doc.text").alias("text")), SHINGLE, PERCENT, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    least = rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(groups, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    return rows.join(least.select("row"), "row", "left_semi").select("doc.*")


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes that an earlier one has; n_chars is counted anew.

    A character of which a byte went goes whole. A text that is nothing but repeats becomes empty; a
    null text too. What a row loses depends on its id and text alone, so the cut text is found by both.
    """
    cut = suffix_dedup(docs, with_text=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("text_sha256").alias("cut_of"), F.col("kept_text").alias("cut_text")).dropDuplicates(["cut_id", "cut_of"])
    rows = docs.select(F.struct("*").alias("doc"))
    # without the hint Spark takes the texts for as small as the references that they are read by, and broadcasts them
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("cut_id")) & (F.sha2(F.col("doc.text").cast("binary"), 256) == F.col("cut_of"))
    joined = rows.join(cut.hint("merge"), same, "left").select(F.col("doc").withField("text", F.coalesce("cut_text", "doc.text", F.lit(""))).alias("doc"))
    return counted(joined.select("doc.*"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, and a last partial time as its first words one space apart."""
    rows = with_row(spark, docs)
    flat = rows.select("row", *[F.col(f"doc.{c}").alias(c) for c in ("doc_id", "text", "source")])
    takes = mix_sources(flat, carry=("row",)).filter("taken > 0").select("row", "size", "taken")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    times = rows.join(takes, "row").withColumn("time", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("time") <= whole, F.col("doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), rest), " "))
    return counted(times.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids along the curve."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_spans),
    ("mixing sources to target weights", mix_to_weights),
    ("packing", pack),
]

#: SQL can't express the near-copy, suffix and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the written table of the one before."""
    where = shared_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else save(out, f"{where}/{k}")
    return docs
