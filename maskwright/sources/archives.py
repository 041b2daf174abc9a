"""ZIP archives put together by tasks: members are deflated wherever their rows are, then each archive is streamed from them."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import shared_folder

#: Bytes that are held while an archive is copied together.
CHUNK = 1 << 20
MEMBER = "job_id string, seq long, name string, path string, at long, packed long, size long, crc long"

# The ZIP format's signatures, versions, flag of UTF-8 names, method deflate and the first day of its calendar.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION, VERSION64, UTF8_NAMES, DEFLATE, FIRST_DAY = 20, 45, 0x800, 8, 0x21
MOST32, MOST16 = 0xFFFFFFFF, 0xFFFF


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8_NAMES, DEFLATE, 0, FIRST_DAY, crc, packed, size, len(name), 0) + name


def central_header(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    """An entry of the directory; a place beyond 4 GB goes to an extra field."""
    extra = struct.pack("<HHQ", 1, 8, at) if at >= MOST32 else b""
    need = VERSION64 if extra else VERSION
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, need, need, UTF8_NAMES, DEFLATE, 0, FIRST_DAY, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, min(at, MOST32)) + name + extra


def end_records(count: int, length: int, at: int) -> bytes:
    """What follows the directory; with the 64-bit records where the plain one can't hold the numbers."""
    out = b""
    if count >= MOST16 or length >= MOST32 or at >= MOST32:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, count, count, length, at) + struct.pack("<IIQI", LOCATOR, 0, at + length, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(count, MOST16), min(count, MOST16), min(length, MOST32), min(at, MOST32), 0)


def packed_members(outputs: DataFrame, root: str) -> DataFrame:
    """``MEMBER`` rows of (job_id, seq, name, content): each task deflates its rows one by one into a file of its own; a repeated task writes another."""

    def work(batches):
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        path, out, at = f"{folder}/{uuid.uuid4().hex}", None, 0
        for batch in batches:
            rows = []
            for job, seq, name, content in zip(*(batch.column(k) for k in range(4))):
                data = content.as_buffer() if content.is_valid else b""
                pack = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = pack.compress(data) + pack.flush()
                out = out or fs.open_output_stream(path, compression=None)
                out.write(body)
                rows.append((job.as_py(), seq.as_py(), name.as_py(), path, at, len(body), len(data), zlib.crc32(data)))
                at += len(body)
            if rows:
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["job_id", "seq", "name", "path", "at", "packed", "size", "crc"])
        if out:
            out.close()

    given = outputs.select(F.col("job_id").cast("string"), F.col("seq").cast("long"), F.coalesce("name", F.lit("document")).alias("name"), F.col("content").cast("binary"))
    return given.mapInArrow(work, MEMBER)


def write_archives(outputs: DataFrame, folder: str | None = None) -> DataFrame:
    """(job_id, path, members, bytes) of an archive for each job of (job_id, seq, name, content), members by seq and name, repeated names as they are.

    Members are deflated by all tasks, however their jobs are spread, and their rows saved; places in the archive come from running totals of those rows. An archive is one file, so one
    task writes it, copying members in pieces of ``CHUNK``: it holds one piece and the directory, never a member. Its file gets a new name in each attempt, and only the row that is
    returned names it. A null content is empty, a null name ``document``, a null job a job. Files and rows stay under ``folder``, by default a new one under ``spark.checkpoint.dir``.
    """
    spark = outputs.sparkSession
    root = folder or shared_folder(spark, "archives")
    packed_members(outputs, f"{root}/members").write.parquet(f"{root}/rows")
    rows = spark.read.schema(MEMBER).parquet(f"{root}/rows")
    by_job = Window.partitionBy("job_id").orderBy("seq", "name", "path", "at")
    length = F.lit(30) + F.octet_length("name") + F.col("packed")
    placed = rows.withColumn("start", F.sum(length).over(by_job) - length)

    def work(batches):
        from pyarrow import fs as pafs

        fs, target = pafs.FileSystem.from_uri(f"{root}/zips")
        fs.create_dir(target, recursive=True)
        job, out, path, directory, end, done = None, None, None, [], 0, []

        def close():
            out.write(b"".join(directory))
            length = sum(map(len, directory))
            tail = end_records(len(directory), length, end)
            out.write(tail)
            out.close()
            done.append((job, path, len(directory), end + length + len(tail)))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["job_id"] != job:
                    if out is not None:
                        close()
                    job, path, directory, end = r["job_id"], f"{target}/{uuid.uuid4().hex}.zip", [], 0
                    out = fs.open_output_stream(path, compression=None)
                name = r["name"].encode()
                out.write(local_header(name, r["crc"], r["packed"], r["size"]))
                with fs.open_input_file(r["path"]) as source:
                    source.seek(r["at"])
                    left = r["packed"]
                    while left:
                        piece = source.read(min(left, CHUNK))
                        if not piece:
                            raise OSError(f"{r['path']} ends early")
                        out.write(piece)
                        left -= len(piece)
                directory.append(central_header(name, r["crc"], r["packed"], r["size"], r["start"]))
                end = r["start"] + 30 + len(name) + r["packed"]
        if out is not None:
            close()
        if done:
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["job_id", "path", "members", "bytes"])

    made = placed.repartition("job_id").sortWithinPartitions("job_id", "start").mapInArrow(work, "job_id string, path string, members long, bytes long")
    made.write.parquet(f"{root}/archives")
    scheme = root.split("://")[0] + "://" if "://" in root else ""
    return spark.read.schema(made.schema).parquet(f"{root}/archives").withColumn("path", F.concat(F.lit(scheme), "path") if scheme == "file://" else F.col("path"))


def archive_members(archives: DataFrame) -> DataFrame:
    """(job_id, name, size, content) of every member of archives (job_id, path): directories first, then members dealt over tasks and each read by its own range."""

    def directories(batches):
        from pyarrow import fs as pafs

        for batch in batches:
            for job, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    infos = z.infolist()
                for at in range(0, len(infos), 10_000):
                    some = infos[at : at + 10_000]
                    columns = [[job] * len(some), [path] * len(some), [i.filename for i in some], [i.header_offset for i in some], [i.compress_size for i in some], [i.CRC for i in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 3)], names=["job_id", "path", "name", "at", "packed", "crc"])

    def contents(batches):
        from pyarrow import fs as pafs

        for batch in batches:
            for r in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(r["path"])
                with fs.open_input_file(name) as f:
                    f.seek(r["at"])
                    head = f.read(30)
                    f.seek(r["at"] + 30 + sum(struct.unpack("<HH", head[26:])))
                    data = zlib.decompress(f.read(r["packed"]), -15)
                if zlib.crc32(data) != r["crc"]:
                    raise ValueError(f"{r['name']} of {r['path']} is damaged")
                yield pa.RecordBatch.from_arrays([pa.array([r["job_id"]], pa.string()), pa.array([r["name"]], pa.string()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["job_id", "name", "size", "content"])

    listed = archives.select("job_id", "path").mapInArrow(directories, "job_id string, path string, name string, at long, packed long, crc long")
    return listed.repartition("path", "at").mapInArrow(contents, "job_id string, name string, size long, content binary")


def download(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, code, reason, file_name, path) for each request (job_id) from jobs (job_id, status, path): 404 without such a job, 400 until it is completed, 500 if its archive is missing."""
    known = jobs.select("job_id", "status", "path", F.lit(True).alias("_known"))
    rows = requests.select("job_id").join(known, "job_id", "left")
    case = lambda missing, early, lost, fine: F.when(F.col("_known").isNull(), missing).when(~F.col("status").eqNullSafe(F.lit("completed")), early).when(F.col("path").isNull(), lost).otherwise(fine)
    nothing: Column = F.lit(None).cast("string")
    early = F.concat(F.lit("job not finished: "), F.coalesce("status", F.lit("unknown")))
    name = F.concat(F.lit("anonymise_"), F.left(F.col("job_id").cast("string"), F.lit(8)), F.lit(".zip"))
    return rows.select(
        "job_id",
        case(F.lit(404), F.lit(400), F.lit(500), F.lit(200)).alias("code"),
        case(F.lit("job unknown or expired"), early, F.lit("archive missing"), nothing).alias("reason"),
        case(nothing, nothing, nothing, name).alias("file_name"),
        case(nothing, nothing, nothing, F.col("path")).alias("path"),
    )
