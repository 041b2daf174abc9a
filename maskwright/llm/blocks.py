"""Texts in shared block files, fetched by reference instead of being shuffled again."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, rows_to_batch, save

#: UTF-8 bytes of text in a block; one document may exceed it and then fills a block alone.
BLOCK_BYTES = 8 << 20

INDEX = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_bytes", pa.int64()), ("mark", pa.int64())])
INDEX_SQL = "doc_id long, block long, offset long, length long, n_bytes long, mark long"


def block_uri(where: str, block: int) -> str:
    return f"{where}/{block:016x}.blk"


def write_blocks(docs: DataFrame, where: str, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write every text as a compressed frame of a block file; return and save the index of them.

    ``mark`` is a hash of the text, which tells texts of one id apart. Each attempt of a task names its files anew and the index, committed once, names those that
    count. Null text is empty; callers keep rows without an id apart.
    """

    def work(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        fs, folder = open_fs(where)
        fs.create_dir(folder, recursive=True)
        rows, parts, raw, size = [], [], 0, 0
        block = uuid.uuid4().int >> 65

        def close():
            with fs.open_output_stream(open_fs(block_uri(where, block))[1], compression=None) as f:
                f.write(b"".join(parts))
            return rows_to_batch(INDEX, list(zip(*rows)))

        for batch in batches:
            for doc_id, body, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if doc_id is None:
                    raise ValueError(f"{id_col} is null")
                data = (body.as_py() or "").encode("utf-8")
                if rows and raw + len(data) > block_bytes:
                    yield close()
                    rows, parts, raw, size, block = [], [], 0, 0, uuid.uuid4().int >> 65
                packed = press.compress(data)
                rows.append((doc_id, block, size, len(packed), len(data), mark))
                parts.append(packed)
                raw, size = raw + len(data), size + len(packed)
        if rows:
            yield close()

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("mark"))
    return save(body.mapInArrow(work, INDEX_SQL), where + "/index")


def read_block(where: str, block: int, spans) -> list[bytes]:
    """The texts of one block at (offset, length) spans."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    fs, path = open_fs(block_uri(where, block))
    with fs.open_input_stream(path, compression=None) as f:
        raw = f.read()
    return [unpress.decompress(raw[o : o + n]) for o, n in spans]


class Fetcher:
    """Reads texts by reference, keeping some open files and the latest parsed documents, as many as ``keep_bytes`` hold."""

    def __init__(self, where: str, parse, keep_bytes: int = 32 << 20):
        import zstandard

        self.where, self.parse, self.keep_bytes = where, parse, keep_bytes
        self.unpress = zstandard.ZstdDecompressor()
        self.files: dict = {}
        self.parsed: dict = {}
        self.held = 0

    def get(self, block: int, offset: int, length: int):
        key = (block, offset)
        if key in self.parsed:
            return self.parsed[key]
        if block not in self.files:
            if len(self.files) >= 16:
                self.files.pop(next(iter(self.files))).close()
            fs, path = open_fs(block_uri(self.where, block))
            self.files[block] = fs.open_input_file(path)
        value = self.parse(self.unpress.decompress(self.files[block].read_at(length, offset)))
        self.held += value.nbytes
        while self.parsed and self.held > self.keep_bytes:
            self.held -= self.parsed.pop(next(iter(self.parsed))).nbytes
        self.parsed[key] = value
        return value
