"""Sources and sinks: files, project and client tables, mapping documents and archives."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import distinct_terms, file_type, slug, trim_py

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PROJECT_SCHEMA = "id string, name string, client string, created_at string, terms array<string>, entities map<string,array<string>>, logo_hashes array<string>"
MAPPING_ENTRY = "struct<original:string,placeholder:string,type:string,source:string,confidence:int>"
MAPPING_SCHEMA = f"session_id string, created_at string, source_file string, file_type string, project_id string, entities array<{MAPPING_ENTRY}>"


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer splits than there are cores, dealt once to all of them; any other as it is.

    A small file is often one row group, which no reader can split; a large table has splits enough and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def office_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(doc_id, path, filename, file_type, length, content) of a folder; other suffixes have a null file_type."""
    reader = spark.readStream.schema(FILE_SCHEMA) if streaming else spark.read
    df = reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.sha2("path", 256).alias("doc_id"), "path", name.alias("filename"), file_type(name).alias("file_type"), "length", "content")


def _parsed(df: DataFrame, schema: str, pick) -> DataFrame:
    """Rows that ``pick(package)`` makes of each supported file, one file in memory at a time; a bad file gives none, and a row of ``unreadable``."""
    from .ooxml import Package

    arrow_schema = df.sparkSession.createDataFrame([], schema).schema
    names = arrow_schema.fieldNames()
    target = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in arrow_schema])

    def work(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(doc_id, k, *row) for k, row in enumerate(pick(Package(content.as_py())))]
                except (zipfile.BadZipFile, KeyError, SyntaxError, AttributeError, TypeError):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), target)], names=names)

    return df.filter("file_type is not null").select(F.col("doc_id").cast("string"), "content").mapInArrow(work, schema)


def unreadable(files: DataFrame) -> DataFrame:
    """(doc_id, error) of the files of a supported type that ``text_blocks`` and the others get no rows from because they are damaged; the null file among them."""
    from . import ooxml

    def work(batches):
        for batch in batches:
            bad = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    ooxml.text_blocks(ooxml.Package(content.as_py()))
                except (zipfile.BadZipFile, KeyError, SyntaxError, AttributeError, TypeError) as e:
                    bad.append((doc_id, f"{type(e).__name__}: {e}"))
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*bad)], names=["doc_id", "error"])

    return files.filter("file_type is not null").select(F.col("doc_id").cast("string"), "content").mapInArrow(work, "doc_id string, error string")


def text_blocks(files: DataFrame) -> DataFrame:
    from . import ooxml

    return _parsed(files, "doc_id string, block_seq int, section string, text string", ooxml.text_blocks)


def alt_texts(files: DataFrame) -> DataFrame:
    from . import ooxml

    return _parsed(files, "doc_id string, seq int, alt_text string, location string", ooxml.alt_texts)


def images(files: DataFrame) -> DataFrame:
    """One row per shown picture with its hash, size and bytes; a picture that can't be read has a null hash, one without a known header null sizes."""
    from . import ooxml
    from ..operators.images import perceptual_hash

    def rows(pkg):
        for where, layer, part in ooxml.images(pkg):
            data = pkg.parts[part]
            width, height = ooxml.image_size(data) or (None, None)
            yield where, layer, part, width, height, perceptual_hash(data), data

    return _parsed(files, "doc_id string, idx int, location string, source_layer string, part string, width int, height int, phash string, content binary", rows)


def package_parts(files: DataFrame) -> DataFrame:
    return _parsed(files, "doc_id string, seq int, name string, data binary", lambda pkg: list(pkg.parts.items()))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects and clients of both layouts, one JSON document a file, by file name: id, name, terms, logo_hashes, term_count."""
    raw = spark.read.schema(PROJECT_SCHEMA).option("multiLine", "true").json(path).select("*", "_metadata.file_name")
    return normal_projects(raw.orderBy("file_name"))


def by_id(rows: DataFrame, value, column: str = "id") -> DataFrame:
    """The client, project or result of an id; no row where there is none, which a service answers as not found."""
    return rows.filter(F.col(column) == F.lit(value))


def normal_projects(raw: DataFrame) -> DataFrame:
    """A flat term list wins over categories; a missing name falls back to client, then id. Sorted reading order is the id's."""
    flat = F.coalesce("terms", F.flatten(F.map_values("entities")), F.array().cast("array<string>"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("client", F.lit("")), "id", F.lit(""))
    return raw.select("id", name.alias("name"), flat.alias("terms"), F.coalesce("logo_hashes", F.array().cast("array<string>")).alias("logo_hashes"), "created_at", F.size(flat).alias("term_count"))


def project_terms(raw: DataFrame) -> DataFrame:
    """(project_id, cat_ord, category, term_ord, term): flat terms are one category, others keep theirs."""
    both = F.when(F.col("terms").isNotNull(), F.create_map(F.lit("autres"), "terms")).otherwise(F.col("entities"))
    rows = raw.select(F.col("id").alias("project_id"), F.posexplode(F.map_entries(both)).alias("cat_ord", "e"))
    return rows.select("project_id", "cat_ord", F.col("e.key").alias("category"), F.posexplode("e.value").alias("term_ord", "term"))


def upsert_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, name, terms, created_at) after the changes: the latest row of each id; a nameless change is refused by being dropped.

    A change without id takes its name's slug; terms are trimmed and distinct but for case.
    """
    new = changes.withColumn("name", trim_py(F.coalesce("name", F.lit("")))).filter("name <> ''")
    new = new.select(F.coalesce(F.nullif("id", F.lit("")), slug(F.col("name"))).alias("id"), "name", distinct_terms(F.coalesce("terms", F.array().cast("array<string>"))).alias("terms"), "created_at")
    rows = clients.select("id", "name", "terms", "created_at", F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    return rows.groupBy("id").agg(F.max_by(F.struct("name", "terms", "created_at"), F.struct("_new", "created_at")).alias("r")).select("id", "r.*")


def project_record(forms: DataFrame) -> DataFrame:
    """(id, name, client, created_at, entities, logo_hashes) of (name, client, created_at, entities[, logo_hashes]); the id is the name's slug, empty if nothing is left of it."""
    hashes = F.coalesce("logo_hashes", F.array().cast("array<string>")) if "logo_hashes" in forms.columns else F.array().cast("array<string>")
    return forms.select(slug(F.col("name"), "").alias("id"), "name", "client", "created_at", "entities", hashes.alias("logo_hashes"))


def data_root(spark: SparkSession, default: str) -> str:
    """Folder of projects and results: spark.maskwright.data where set."""
    return spark.conf.get("spark.maskwright.data", default)


def restored_name(name: Column) -> Column:
    return F.concat(F.lit("restaure_"), name)


def restore_history(restores: DataFrame) -> DataFrame:
    """Restores of (doc_id, ts, ...), the newest first."""
    return restores.orderBy(F.desc("ts"), "doc_id")


def delete_client(clients: DataFrame, client_id: str) -> DataFrame:
    return clients.filter(~F.col("id").eqNullSafe(F.lit(client_id)))


def mapping_header(outputs: DataFrame) -> DataFrame:
    """Header of each mapping document from (doc_id, source_file, project_id, finished_at): a stable session id, the time in ISO form and the file type."""
    seconds = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss")
    session = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "source_file", seconds))
    return outputs.select("doc_id", session.alias("session_id"), seconds.alias("created_at"), "source_file", file_type(F.col("source_file")).alias("file_type"), "project_id")


def replacement_view(mapping: DataFrame) -> DataFrame:
    """What a reader is shown of mapping rows: original, placeholder and source, entries without a placeholder left out."""
    return mapping.filter("placeholder is not null and placeholder <> ''").select("doc_id", "original", "placeholder", "source")


def mapping_json(mapping: DataFrame, header: DataFrame) -> DataFrame:
    """(doc_id, mapping_json) from mapping rows and (doc_id, session_id, created_at, source_file, file_type, project_id)."""
    entry = F.struct("seq", F.struct("original", "placeholder", "type", "source", "confidence").alias("e"))
    listed = mapping.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entities"))
    whole = header.join(listed, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{MAPPING_ENTRY}>")))
    doc = F.struct("session_id", "created_at", "source_file", "file_type", "project_id", "entities")
    return whole.select("doc_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("mapping_json"))


def read_mapping(df: DataFrame, column: str = "mapping_json") -> DataFrame:
    """Mapping rows (doc_id, seq, ...) of JSON documents; ``bad`` marks a document that can't be read."""
    parsed = df.select("doc_id", F.from_json(column, MAPPING_SCHEMA, {"mode": "PERMISSIVE"}).alias("m"), F.expr(f"try_parse_json({column}) is null").alias("bad"))
    return parsed.select("doc_id", "bad", F.posexplode_outer("m.entities").alias("seq", "e")).select("doc_id", "bad", "seq", "e.*")


def inline_terms(manual: Column, extra: Column) -> Column:
    """Struct of (manual_bad, manual map, extra list) from the two JSON parameters of a request.

    Bad manual terms are an error for the caller to raise; a bad extra list counts as empty.
    """
    m = F.from_json(manual, "map<string,array<string>>")
    e = F.filter(F.transform(F.coalesce(F.from_json(extra, "array<string>"), F.array().cast("array<string>")), trim_py), lambda t: t != "")
    return F.struct((manual.isNotNull() & m.isNull()).alias("manual_bad"), m.alias("manual"), e.alias("extra"))


def zip_archives(outputs: DataFrame) -> DataFrame:
    """(job_id, zip) of (job_id, seq, name, content): a job's files deflated in order; a job is at most ``limit`` files by the batch rule."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in pdf.sort_values("seq")[["name", "content"]].itertuples(index=False):
                z.writestr(name, content)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "zip": [buffer.getvalue()]})

    return outputs.groupBy("job_id").applyInPandas(pack, "job_id string, zip binary")


def write_files(outputs: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) as files of a shared folder; (name, bytes) of what was written."""

    def work(batches):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                with fs.open_output_stream(f"{root}/{re.sub(r'[/\\\\]', '_', name)}", compression=None) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return outputs.select("name", "content").mapInArrow(work, "name string, bytes long")
