"""Length-delimited binary token records with masked checksums, and their offset index.

A file is a run of frames, little-endian:

    uint64 length of data | uint32 masked crc of those 8 bytes | data | uint32 masked crc of data

``data`` is int64 document id, uint8 bytes for each id (2 or 4; 128 more where the document has no id), then the ids. A masked crc is crc32 turned
right by 15 bits plus 0xA282EAD8, modulo 2**32, so that a crc over bytes holding crcs stays sound.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, partitions, rows_to_batch, save, tasks_for
from .tokens import TextEncoder, encoded

HEAD, TAIL, DATA = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")
#: A file is closed once it holds this many bytes.
FILE_BYTES = 64 << 20
BUFFER = 4 << 20
NO_ID = 128


def masked(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    data = DATA.pack(doc_id or 0, ids.dtype.itemsize | (NO_ID if doc_id is None else 0)) + ids.astype(ids.dtype.newbyteorder("<")).tobytes()
    size = struct.pack("<Q", len(data))
    return size + TAIL.pack(masked(size)) + data + TAIL.pack(masked(data))


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = DATA.unpack_from(data)
    return None if width & NO_ID else doc_id, np.frombuffer(data, "<u2" if width & ~NO_ID == 2 else "<u4", offset=DATA.size)


def frames(stream, where: str = ""):
    """(doc_id, ids) of each frame of an open file, with both checksums verified."""
    while head := stream.read(HEAD.size):
        size, crc = HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError(f"damaged length in {where}")
        data, tail = stream.read(size), stream.read(TAIL.size)
        if len(data) != size or len(tail) != TAIL.size or masked(data) != TAIL.unpack(tail)[0]:
            raise ValueError(f"damaged record in {where}")
        yield parse(data)


def read_at(uri: str, offset: int) -> tuple[int, np.ndarray]:
    """The record at an offset of the index: a shuffled read."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return next(frames(f, uri))


INDEX = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
INDEX_SQL = "doc_id long, part long, seq long, file string, offset long, length long, n_tokens long"


def write_records(docs: DataFrame, where: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending id order and return the offset index, saved in ``where``/index.

    A file's name is new in every attempt of a task, and only files named in the index, which Spark
    commits once, are part of the set. Null text has the end id alone; null ids come first and stay null; rows with the same id stay side
    by side, ordered by a hash of the text. A text is encoded whole, however long; an empty table gives an empty index; other columns are not read.
    """

    def work(batches):
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), -1, TextEncoder.load(tokenizer)
        fs, folder = open_fs(where)
        fs.create_dir(folder, recursive=True)
        out, size, name, buffer = None, 0, "", bytearray()
        try:
            for batch in batches:
                rows = []
                texts = (v.as_py() for v in batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encoder, texts)):
                    if out is None:
                        seq, size = seq + 1, 0
                        name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    if end_id is not None:
                        ids = np.append(ids, encoder.dtype(end_id))
                    data = frame(doc_id, ids)
                    rows.append((doc_id, part, seq, f"{where}/{name}", size, len(data), len(ids)))
                    buffer += data
                    size += len(data)
                    if len(buffer) >= BUFFER:
                        out.write(bytes(buffer))
                        buffer.clear()
                    if size >= file_bytes:
                        out.write(bytes(buffer))
                        buffer.clear()
                        out.close()
                        out = None
                if rows:
                    yield rows_to_batch(INDEX, list(zip(*rows)))
        finally:
            if out is not None:
                out.write(bytes(buffer))
                out.close()

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = dealt.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    key = ["doc_id", F.xxhash64("text")]
    dealt = dealt.repartitionByRange(tasks_for(docs.sparkSession, total), *key).sortWithinPartitions(*key)
    return save(dealt.mapInArrow(work, INDEX_SQL), where + "/index")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_records(index: DataFrame) -> DataFrame:
    """Read back every file of the index in order: doc_id, start, n_tokens and ids_crc32 of each record.

    The files' totals, a row for each file, give the ids before each file.
    """
    files = index.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("base"))

    def work(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_stream(path, compression=None, buffer_size=BUFFER) as f:
                    for doc_id, ids in frames(f, uri):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 5000:
                            yield rows_to_batch(READ, list(zip(*rows)))
                            rows = []
                if rows:
                    yield rows_to_batch(READ, list(zip(*rows)))

    return files.repartition(partitions(index.sparkSession), "file").mapInArrow(work, READ_SQL)
