"""Suffix-array deduplication: bytes inside strings that also start in an earlier document are removed.

1. Texts are written once to shared block files.
2. Every string of ``length`` bytes has a minimizer, the least hashed k-gram inside it, so equal
   strings have equal minimizers. Each block sends its distinct minimizers to buckets by hash and learns which of them other blocks hold too.
3. For those alone a block sends the distinct stretches of text that hold the strings of a minimizer, each with
   its least document id. A bucket lays its stretches end to end, orders their suffixes by external induced sorting, and takes runs of
   suffixes with a common prefix of ``length`` bytes as equal strings.
4. The answer, a bit for each string sent, goes back to the block, which marks its documents.

Whatever many documents share is one row for each block before any shuffle. A minimizer met very often may still have
many stretches, all unlike, around one phrase; its strings are dealt by the bytes that ``WINDOW`` neighbours
have in common, all but three of each, instead of by the minimizer, and so spread over the buckets like others.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import read_block, write_blocks
from .common import partitions, remove, rows_to_batch, save, shared_dir
from .induced import suffix_order

#: Production parameters.
LENGTH = 50
GRAM = 20
#: Text bytes for each bucket, which sets their number.
BUCKET_BYTES = 8 << 20
#: A minimizer of more runs has its stretches split into pieces of ``WINDOW`` strings, dealt by the bytes that all strings of a piece hold.
HOT_RUNS = 20_000
WINDOW = 4

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_POS = 25


@lru_cache(1)
def _byte_table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64)) * _STEP
    x ^= x >> _U(31)
    return x * _U(0xBF58476D1CE4E5B9)


def _power(n: int) -> np.uint64:
    return _U(pow(int(_STEP), n, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k-gram, built by doubling."""
    n = len(data)
    level, size = _byte_table()[data], 1
    out, done = None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, done = level, size
            else:
                m = min(len(out), len(level) - done)
                out = out[:m] * _power(size) + level[done : done + m]
                done += size
        rest >>= 1
        if rest:
            level = level[: len(level) - size] * _power(size) + level[size:]
            size *= 2
    out = out[: n - k + 1]
    out = out ^ (out >> _U(29))
    out = out * _U(0x94D049BB133111EB)
    return out ^ (out >> _U(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    level, size = x, 1
    while size * 2 <= w:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    return np.minimum(level[: len(x) - w + 1], level[w - size : len(x) - size + 1])


def minimizer_runs(data: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Runs of string starts with one minimizer: (hash, first start, last start, document, place of the minimizer).

    ``data`` is texts end to end; strings don't cross texts. Of equal least k-grams the first counts.
    Long data is taken in pieces that stay in cache; a run may then be two, which changes no string's minimizer.
    """
    out = ([], [], [], [], [])
    w = length - k + 1
    begins = np.concatenate([[0], ends[:-1]])
    at = 0
    total = int(ends[-1]) if len(ends) else 0
    while at + length <= total:
        upto = min(total, at + (1 << 18) + length)
        h = gram_hashes(data[at:upto], k)
        key = (h & ~_U((1 << _POS) - 1)) | np.arange(len(h), dtype=np.uint64)
        m = (_sliding_min(key, w) & _U((1 << _POS) - 1)).astype(np.int64)
        starts = np.arange(at, at + len(m))
        doc = np.searchsorted(ends, starts, side="right")
        inside = starts + length <= ends[doc]
        first = np.ones(len(m), bool)
        first[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
        first &= inside
        f = np.flatnonzero(first)
        if len(f):
            last_ok = np.minimum(np.append(f[1:], len(m)) - 1, ends[doc[f]] - length - at)
            out[0].append(h[m[f]])
            out[1].append(f + at)
            out[2].append(last_ok + at)
            out[3].append(doc[f])
            out[4].append(m[f] + at)
        at += len(m)
    del begins
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if i == 0 else np.int64) for i, x in enumerate(out))


def _block(where: str, block: int, index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, document ids) of a block, documents in ascending id."""
    rows = sorted(zip(index["doc_id"], index["offset"], index["length"]))
    texts = read_block(where, block, [(o, n) for _, o, n in rows])
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends, np.array([r[0] for r in rows], np.int64)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(buckets)).astype(np.int64)


def _distinct(hashes: np.ndarray, ids: np.ndarray, buckets: int):
    """Distinct hashes in (bucket, hash) order, whether two ids of the block hold each, bounds by bucket and runs of each."""
    by = np.lexsort((ids, hashes, _bucket_of(hashes, buckets)))
    h, d = hashes[by], ids[by]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    low, high = d[first], d[np.append(first[1:], len(h)) - 1] if len(h) else d
    unique = h[first]
    bounds = np.searchsorted(_bucket_of(unique, buckets), np.arange(buckets + 1))
    return unique, low != high, bounds, np.diff(np.append(first, len(h)))


def split_runs(data, runs, length: int, window: int = WINDOW):
    """The runs in pieces of at most ``window`` strings, each keyed by the bytes that all strings of such a piece hold.

    Where a string's minimizer lies is a matter of the string alone, so equal strings fall in pieces of one key.
    """
    h, a, b, doc, place = runs
    low, high = (place - b) // window, (place - a) // window
    times = high - low + 1
    run = np.repeat(np.arange(len(h)), times)
    piece = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    core = place[run] - piece * window
    key = gram_hashes(data, length - window + 1)[core] + piece.astype(np.uint64) * _STEP
    key = (key ^ (key >> _U(29))) * _U(0x94D049BB133111EB)
    return key ^ (key >> _U(32)), np.maximum(a[run], core - window + 1), np.minimum(b[run], core), doc[run], place[run]


def _stretch_table(data, runs, shared: np.ndarray, hot: np.ndarray, unique: np.ndarray, ids: np.ndarray, buckets: int, length: int):
    """Distinct stretches of the shared minimizers in a fixed order.

    Returns (starts and document ids of the runs taken, stretch of each, stretch starts, sizes, hashes, least document ids, bounds by bucket).
    """
    by = np.argsort(unique, kind="stable")
    slot = by[np.searchsorted(unique[by], runs[0])]
    common = np.flatnonzero(shared[slot] & hot[slot])
    taken = [x[shared[slot] & ~hot[slot]] for x in runs]
    if len(common):
        taken = [np.concatenate(x) for x in zip(taken, split_runs(data, [x[common] for x in runs], length))]
    h, a, b, doc, _ = taken
    size, doc = b - a + length, ids[doc]
    # a stretch is told by minimizer, size and two hashes of its strings: the first and the last of them
    full = gram_hashes(data, length) if len(data) >= length else np.zeros(0, np.uint64)
    head, last = full[a], full[a + size - length]
    order = np.lexsort((doc, last, head, size, h, _bucket_of(h, buckets)))
    cols = [x[order] for x in (h, size, head, last)]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
    first = order[np.flatnonzero(new)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    bounds = np.searchsorted(_bucket_of(h[first], buckets), np.arange(buckets + 1))
    return (a, doc), which, a[first], size[first], h[first], doc[first], bounds


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def earliest(texts: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int, memory: int = 1 << 24) -> np.ndarray:
    """For every string of the stretches end to end in ``texts``, in order, the least document id that holds it.

    The stretches, each closed by a zero symbol, are ordered by external induced sorting; neighbours with a
    common prefix of ``length`` symbols are one string.
    """
    n_strings = sizes - length + 1
    ends = np.cumsum(sizes)
    spaced = np.zeros(int(ends[-1]) + len(sizes) + 1, np.int16)
    begin = ends - sizes + np.arange(len(sizes))
    spaced[np.arange(int(ends[-1])) + np.repeat(np.arange(len(sizes)), sizes)] = texts.astype(np.int16) + 2
    spaced[(begin + sizes)] = 1
    string_of = np.full(len(spaced), -1, np.int64)
    starts = np.repeat(begin, n_strings) + np.arange(int(n_strings.sum())) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
    string_of[starts] = np.arange(len(starts))
    owner = np.repeat(least, n_strings)
    out = owner.copy()
    last = None  # the group left open by the part before: (first position, strings, least)
    for part in suffix_order(spaced, 258, length, memory):
        where = part[string_of[part] >= 0]
        if not len(where):
            continue
        before = np.concatenate([[last[0] if last else where[0]], where[:-1]])
        same = np.ones(len(where), bool)
        active = np.arange(len(where))
        for j in range(length):
            equal = spaced[where[active] + j] == spaced[before[active] + j]
            same[active[~equal]] = False
            active = active[equal]
        group = np.cumsum(~same)
        ids = string_of[where]
        least_of = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_of, group, owner[ids])
        if last is not None and same[0]:
            least_of[0] = min(least_of[0], last[2])
            if least_of[0] < last[2]:
                for old in last[1]:
                    out[old] = least_of[0]
        out[ids] = least_of[group]
        open_now = ids[group == group[-1]]
        carried = last[1] if last is not None and group[-1] == 0 and same[0] else []
        last = (int(where[-1]), [*carried, open_now], int(least_of[-1]))
    return out


def whole_characters(data: np.ndarray, edges: np.ndarray) -> str:
    """The text between removed runs, given by their starts and ends, without characters that lost a byte."""
    cuts = [0, *edges.tolist(), len(data)]
    return "".join(data[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(cuts[::2], cuts[1::2]))


ASK = "bucket long, block long, payload binary"
ASK_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, spans array<long>, text_sha256 string"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string()), ("spans", pa.list_(pa.int64())), ("text_sha256", pa.string())])


def _bits(rows, bounds: np.ndarray, which: int = 0) -> np.ndarray:
    """One flag for each sent item, from the answers of the buckets; an answer may have several such rows of flags."""
    out = np.zeros(int(bounds[-1]), bool)
    for r in rows or []:
        a, b = bounds[r["bucket"]], bounds[r["bucket"] + 1]
        flags = np.frombuffer(r["payload"], np.uint8, offset=which * -(-int(b - a) // 8))
        out[a:b] = np.unpackbits(flags, count=b - a).astype(bool)
    return out


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, where: str | None = None, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES,
    hot_runs: int = HOT_RUNS
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds kept (binary), kept_text, spans and the whole text's text_sha256.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id, judged on the input.
    ``spans`` has the starts and ends of the removed runs by turns. Texts are UTF-8, null is empty; texts shorter than ``length`` keep all.
    Rows that share an id count as one document's: none removes from another. A row without an id is in no order: it keeps all and removes from none. A text
    is judged whole, however long; an empty table gives no rows; other columns, whatever their names, are not read. Removal may
    cut a character, so ``kept`` is binary; ``kept_text`` has the whole characters of it.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "suffix")
    index = write_blocks(docs.filter(F.col(id_col).isNotNull()), where + "/blocks", id_col, text)
    total = index.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-total // bucket_bytes))
    n_tasks = partitions(spark)
    store = where + "/blocks"
    listed = index.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("doc_id", "offset", "length")])
    blocks = save(listed, where + "/listed")

    def scan(row):
        data, ends, ids = _block(store, row["block"], row)
        runs = minimizer_runs(data, ends, length, gram)
        return data, ends, ids, runs, _distinct(runs[0], ids[runs[3]], buckets)

    def rows_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield row

    def ask(batches):
        for row in rows_of(batches):
            unique, _, bounds, count = scan(row)[4]
            count = np.minimum(count, (1 << 16) - 1).astype(np.uint16)
            some = np.flatnonzero(np.diff(bounds))
            parts = [slice(bounds[b], bounds[b + 1]) for b in some]
            yield rows_to_batch(ASK_SCHEMA, [some.tolist(), [row["block"]] * len(some), [unique[s].tobytes() + count[s].tobytes() for s in parts]])

    def met(table: pa.Table) -> pa.Table:
        asked = [(p, len(p) // 10) for p in table.column("payload").to_pylist()]
        parts = [np.frombuffer(p, np.uint64, n) for p, n in asked]
        runs = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in asked])
        _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        common = np.bincount(inverse, weights=runs) > hot_runs
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        flags = zip(np.split(count[inverse] > 1, cuts), np.split(common[inverse], cuts))
        return pa.table([table.column("bucket"), table.column("block"), pa.array([b"".join(np.packbits(x).tobytes() for x in f) for f in flags], pa.binary())], schema=ASK_SCHEMA)

    spread = blocks.repartition(n_tasks, "block")
    first = save(spread.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(met, ASK), where + "/met")
    answers = lambda df, name: df.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
    told = save(blocks.join(answers(first, "met"), "block", "left"), where + "/told")
    remove(spark, where + "/met")

    def stretches(row):
        data, ends, ids, runs, (unique, multi, bounds, _) = scan(row)
        shared = multi | _bits(row["met"], bounds)
        return data, ends, ids, _stretch_table(data, runs, shared, _bits(row["met"], bounds, 1), unique, ids, buckets, length)

    def send(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for row in rows_of(batches):
            data, _, _, (_, _, start, size, h, least, bounds) = stretches(row)
            names, payloads = [], []
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                body = h[s].tobytes() + least[s].tobytes() + size[s].astype(np.uint32).tobytes() + _gather(data, start[s], size[s]).tobytes()
                names.append(b)
                payloads.append(np.int64(bounds[b + 1] - bounds[b]).tobytes() + press.compress(body))
            yield rows_to_batch(ASK_SCHEMA, [names, [row["block"]] * len(names), payloads])

    def judge(table: pa.Table) -> pa.Table:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        hs, leasts, sizes, texts = [], [], [], []
        for p in table.column("payload").to_pylist():
            n = int(np.frombuffer(p[:8], np.int64)[0])
            body = unpress.decompress(p[8:])
            hs.append(np.frombuffer(body, np.uint64, n))
            leasts.append(np.frombuffer(body, np.int64, n, 8 * n))
            sizes.append(np.frombuffer(body, np.uint32, n, 16 * n).astype(np.int64))
            texts.append(np.frombuffer(body, np.uint8, offset=20 * n))
        h, least, size, data = map(np.concatenate, (hs, leasts, sizes, texts))
        starts = np.cumsum(size) - size
        full = gram_hashes(data, length)
        head, tail = full[starts], full[starts + size - length]
        # equal stretches of several blocks are sorted as one
        by = np.lexsort((least, tail, head, size, h))
        new = np.ones(len(by), bool)
        new[1:] = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in (h, size, head, tail)])
        one = by[new]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        # a minimizer with one stretch needs no sorting
        runs = np.concatenate([[True], h[one][1:] != h[one][:-1]])
        alone = runs & np.concatenate([runs[1:], [True]])
        n_strings = size[one] - length + 1
        begin = np.cumsum(n_strings) - n_strings
        answer = np.repeat(least[one], n_strings)
        several = np.flatnonzero(~alone)
        if len(several):
            s, n = size[one][several], n_strings[several]
            found = earliest(_gather(data, starts[one][several], s), s, least[one][several], length)
            answer[np.repeat(begin[several] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = found
        n = n_strings[which]
        flat = answer[np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        earlier = flat < np.repeat(least, n)
        counts = [int(n[a:b].sum()) for a, b in zip(*(lambda c: (np.concatenate([[0], c[:-1]]), c))(np.cumsum([len(x) for x in hs])))]
        flags = np.split(earlier, np.cumsum(counts)[:-1])
        return pa.table([table.column("bucket"), table.column("block"), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], schema=ASK_SCHEMA)

    second = save(told.repartition(n_tasks, "block").mapInArrow(send, ASK).groupBy("bucket").applyInArrow(judge, ASK), where + "/judged")
    last = save(told.join(answers(second, "judged"), "block", "left"), where + "/answered")
    remove(spark, where + "/judged", where + "/told", where + "/listed")

    def finish(batches):
        for row in rows_of(batches):
            data, ends, ids, ((run_start, run_doc), which, _, size, _, least, bounds) = stretches(row)
            n_strings = size - length + 1
            begin = np.concatenate([[0], np.cumsum(n_strings)])
            earlier = _bits(row["judged"], begin[bounds])
            # strings of the runs taken: earlier elsewhere, or earlier in this block
            n = n_strings[which]
            at = np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            start = np.repeat(run_start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            own = np.repeat(run_doc > least[which], n)
            hit = start[earlier[at] | own]
            steps = np.zeros(len(data) + 1, np.int32)
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            out = []
            for doc_id, a, b in zip(ids.tolist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                kept = data[a:b][~mask].tobytes()
                out.append((doc_id, b - a, int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if with_text else None, whole_characters(data[a:b], edges) if with_text else None, edges if with_text else None, hashlib.sha256(data[a:b].tobytes()).hexdigest() if with_text else None))
                if len(out) >= 500:
                    yield rows_to_batch(OUT_SCHEMA, list(zip(*out)))
                    out = []
            if out:
                yield rows_to_batch(OUT_SCHEMA, list(zip(*out)))

    done = last.repartition(n_tasks, "block").mapInArrow(finish, OUT_SQL)
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    hashed, none = F.sha2(raw, 256), F.lit(0).cast("long")
    whole = docs.filter(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), hashed.alias("kept_sha256"),
        raw.alias("kept"), F.decode(raw, "UTF-8").alias("kept_text"), F.array().cast("array<long>").alias("spans"), hashed.alias("text_sha256"),
    )
    done = done.unionByName(whole)
    return done if with_text else done.drop("kept", "kept_text", "spans", "text_sha256")
