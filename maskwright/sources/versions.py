"""Tables rewritten by versions: a new folder of data for each, made valid by one rename."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete_client, upsert_clients

CLIENT_SCHEMA = "id string, name string, terms array<string>, created_at string"


class Conflict(RuntimeError):
    """Another writer has taken the version."""


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder where the cluster's ``spark.checkpoint.dir`` is; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) in a folder; none where there is no folder."""
    hadoop, conf = _hadoop(spark)
    path = hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    return sorted(int(name) for name, _ in _files(spark, f"{root}/commits") if name.isdigit())


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/commits/{version:020d}", wholetext=True).first()[0])


def read_version(spark: SparkSession, root: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """A committed version, the last by default. Data of writers that never committed is not seen; without any version an empty table of ``schema``."""
    known = versions(spark, root)
    if not known and version is None and schema:
        return spark.createDataFrame([], schema)
    if not known or (version or known[-1]) not in known:
        raise FileNotFoundError(f"{root} has no version {version or ''}")
    entry = _manifest(spark, root, version or known[-1])
    return spark.read.schema(entry["schema"]).parquet(f"{root}/data/{entry['folder']}")


def commit_version(df: DataFrame, root: str, base: int) -> int:
    """Write ``df`` as the version after ``base``; ``Conflict`` if somebody else has.

    The data goes to a folder of its own first. A manifest under a temporary name is then renamed to the version's number, which the file system must do in one step
    and refuse where the name exists (HDFS does). A writer lost before that leaves a folder that nobody reads.
    """
    spark, version = df.sparkSession, base + 1
    folder = f"{version:020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/{folder}")
    hadoop, conf = _hadoop(spark)
    waiting, final = (hadoop.fs.Path(f"{root}/commits/{name}") for name in (f".{folder}", f"{version:020d}"))
    fs = waiting.getFileSystem(conf)
    fs.mkdirs(waiting.getParent())
    out = fs.create(waiting, False)
    out.write(json.dumps({"folder": folder, "schema": df._jdf.schema().toDDL()}).encode())
    out.close()
    try:
        hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(waiting, final, spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(waiting, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"version {version} of {root} exists") from e
        raise
    return version


def rewrite(spark: SparkSession, root: str, change, schema: str | None = None, tries: int = 5) -> int:
    """Commit ``change(last version)``; where another writer was first, the change is made anew on what that one wrote."""
    for left in reversed(range(tries)):
        known = versions(spark, root)
        base = known[-1] if known else 0
        try:
            return commit_version(change(read_version(spark, root, base or None, schema)), root, base)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be at least 1")


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_ms: int = 86_400_000) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names and that are older than any running writer or reader; their names."""
    hadoop, conf = _hadoop(spark)
    known = versions(spark, root)
    if not known:
        return []
    named = {_manifest(spark, root, v)["folder"] for v in known[-max(keep, 1) :]}
    limit = spark._jvm.java.lang.System.currentTimeMillis() - older_ms
    gone = [name for name, changed in _files(spark, f"{root}/data") if name not in named and changed <= limit]
    for name in gone:
        path = hadoop.fs.Path(f"{root}/data/{name}")
        path.getFileSystem(conf).delete(path, True)
    for v in known[: -max(keep, 1)]:
        path = hadoop.fs.Path(f"{root}/commits/{v:020d}")
        path.getFileSystem(conf).delete(path, False)
    return gone


def save_clients(spark: SparkSession, root: str, changes: DataFrame) -> int:
    """Commit an upsert of clients."""
    return rewrite(spark, root, lambda old: upsert_clients(old, changes), CLIENT_SCHEMA)


def remove_client(spark: SparkSession, root: str, client_id: str) -> int | None:
    """Commit the deletion of a client; None, without a new version, where there is none of this id."""
    if read_version(spark, root, schema=CLIENT_SCHEMA).filter(F.col("id") == client_id).isEmpty():
        return None
    return rewrite(spark, root, lambda old: delete_client(old, client_id), CLIENT_SCHEMA)
