"""Packing along a space-filling curve: documents in Hilbert order of their projected hashed vectors."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_to_batch, save, shared_dir, tasks_for
from .tokens import TextEncoder, encoded

#: Production parameters.
LENGTH = 4096
END_ID = 2
DIMS, BITS = 4, 12
HASHED = 64
#: A projected coordinate of this size reaches the edge of the grid.
REACH = 1.5
SEED = 20240501


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims), by Skilling's transposed form."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def token_projection(n_ids: int, dims: int = DIMS, hashed: int = HASHED, seed: int = SEED) -> np.ndarray:
    """(n_ids, dims): each id's signed hash bucket, projected by fixed random directions."""
    ids = np.arange(n_ids, dtype=np.uint64)
    h = (ids + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    sign = np.where((h >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)
    directions = np.random.default_rng(seed).normal(size=(hashed, dims))
    return (sign[:, None] * directions[(h % np.uint64(hashed)).astype(np.int64)]).astype(np.float32)


def document_keys(means: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve positions of the documents' mean projections (n, dims)."""
    grid = np.clip((means / REACH + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_key(grid, bits)


STAGED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tail_lengths(left: int, most: int) -> list[int]:
    """Cut the rest of a task's ids into sequences of power-of-two lengths, which need no padding."""
    out = []
    for b in range(most.bit_length() - 1, -1, -1):
        while left >= 1 << b:
            out.append(1 << b)
            left -= 1 << b
    return out


def place(lengths: np.ndarray, first_sequence: int, most: int) -> list[np.ndarray]:
    """Pieces of documents laid end to end: document index, start, length, sequence and offset."""
    total = int(lengths.sum())
    full = total // most
    bounds = np.concatenate([[0], most * np.arange(1, full + 1), full * most + np.cumsum(tail_lengths(total - full * most, most))]).astype(np.int64)
    ends = np.cumsum(lengths)
    cuts = np.union1d(bounds, np.concatenate([[0], ends]))
    a, b = cuts[:-1], cuts[1:]
    doc = np.searchsorted(ends, a, side="right")
    seq = np.searchsorted(bounds, a, side="right") - 1
    return [doc, a - (ends - lengths)[doc], b - a, first_sequence + seq, a - bounds[seq]]


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, where: str | None = None, group_ids: int = 1 << 22
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenized once and staged with their curve position. They are dealt by range of
    (key, doc_id), so copies, which share a key, still spread over tasks. A task lays its documents end to end in that order; the
    rest after its last full sequence is cut at powers of two. Pieces never cross tasks and a task holds a few million ids at a time.
    Null text has the end id alone; a null id stays null; repeated rows are packed again; a text is encoded whole, however long, and then cut
    into pieces; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "pack")

    def stage(batches):
        encoder = TextEncoder.load(tokenizer)
        projection = token_projection(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            doc_ids, means, raw = batch.column(0).to_pylist(), [], []
            for ids in encoded(encoder, (v.as_py() for v in batch.column(1))):
                ids = np.append(ids, encoder.dtype(end_id))
                means.append(projection[ids].mean(axis=0))
                raw.append(ids.tobytes())
            if doc_ids:
                yield rows_to_batch(STAGED, [doc_ids, document_keys(np.array(means)), raw])

    def pack(batches):
        from pyspark import TaskContext

        dtype = TextEncoder.load(tokenizer).dtype
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int, int, np.ndarray, int]] = []  # doc_id, ids before these, ids, ids of the document
        n = 0

        def lay(last: bool):
            nonlocal held, n, sequence
            keep = 0 if last else n % length
            rows, rest = [], []
            spare = keep
            while spare:  # the ids after the last full sequence stay for later
                doc_id, start, ids, total = held.pop()
                cut = max(0, len(ids) - spare)
                rest.append((doc_id, start + cut, ids[cut:], total))
                spare -= len(ids) - cut
                if cut:
                    held.append((doc_id, start, ids[:cut], total))
            if held:
                lengths = np.array([len(x[2]) for x in held], np.int64)
                doc, start, size, seq, offset = place(lengths, sequence, length)
                for d, s, m, q, o in zip(doc.tolist(), start.tolist(), size.tolist(), seq.tolist(), offset.tolist()):
                    doc_id, before, ids, total = held[d]
                    rows.append((doc_id, before + s, m, zlib.crc32(ids[s : s + m].astype("<u4").tobytes()), total, q, o))
                sequence = int(seq[-1]) + 1
            held, n = rest[::-1], keep
            return rows

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype)
                held.append((doc_id, 0, ids, len(ids)))
                n += len(ids)
                if n >= group_ids and (rows := lay(False)):
                    yield rows_to_batch(PIECES, list(zip(*rows)))
        if held and (rows := lay(True)):
            yield rows_to_batch(PIECES, list(zip(*rows)))

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    staged = save(body.mapInArrow(stage, "doc_id long, key long, ids binary"), where + "/staged")
    total = staged.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    order = ["key", "doc_id", F.xxhash64("ids")]
    dealt = staged.repartitionByRange(tasks_for(spark, total), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(pack, PIECES_SQL)
