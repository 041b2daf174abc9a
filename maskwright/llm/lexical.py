"""Ranked lexical search: an inverted index in shards, each searched by MaxScore."""

from __future__ import annotations

import io
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, partitions, rows_to_batch, save, shared_dir

#: Production parameters: documents returned for an item.
K = 20
#: UTF-8 bytes of text in a shard; one document may exceed it and then closes its shard.
SHARD_BYTES = 8 << 20
#: Shards that a block of items meets one after another, handing on the k-th best score; items of a block.
GROUP, ITEMS = 16, 128
#: Shards that a task holds in memory.
HELD = 6
#: The ranking, in whole numbers: a term's share is SCALE * tf div (1000 * tf + SATURATION * m), with m = LEAST + (SLOPE * n * N) div L.
SCALE, SATURATION, SLOPE, LEAST = 1_000_000_000, 12, 25, 75

#: Bytes of terms stay, A-Z lower-cased; all others part terms. Every character beyond ASCII is of a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def share(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What an occurrence count adds for each unit of weight, in a document of n terms: it rises with tf and falls with n."""
    m = LEAST + (SLOPE * n.astype(np.int64) * docs) // total
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


class Filling:
    """A shard being filled: terms get numbers when first met, so a text is held as its numbers and never as its terms."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.known: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        known = self.known
        self.ids.append(doc_id)
        self.numbers.append(np.fromiter((known.setdefault(t, len(known)) for t in words), np.int32, len(words)))
        self.size += sum(map(len, words)) + len(words)


def build_shard(filling: Filling) -> dict[str, np.ndarray]:
    """Inverted lists of documents (number in the shard, tf), by term in byte order, with what bounds each list.

    A list's bound needs N and L, known only later: it keeps the pairs (tf, n) that no other pair beats in both.
    """
    known, ids = filling.known, filling.ids
    n = np.array([len(w) for w in filling.numbers], np.int64)
    names = sorted(known)
    rank = np.empty(len(names), np.int64)
    rank[[known[t] for t in names]] = np.arange(len(names))
    both, tf = np.unique(rank[np.concatenate(filling.numbers)] * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
    term, doc = both // len(ids), both % len(ids)
    by = np.lexsort((n[doc], -tf, term))
    length = n[doc][by]
    # a running minimum that starts anew with each term: later terms lie wholly below earlier ones
    step = int(n.max(initial=0)) + 1
    low = np.minimum.accumulate(length - term[by] * step)
    better = np.ones(len(by), bool)
    better[1:] = low[1:] < low[:-1]
    edge = by[better]
    return {
        "ids": np.array([0 if i is None else i for i in ids], np.int64),
        "no_id": np.array([i is None for i in ids], bool),
        "n": n.astype(np.int32),
        "names": np.frombuffer(b"".join(names), np.uint8),
        "ends": np.cumsum([len(t) for t in names]).astype(np.int64),
        "starts": np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int64),
        "docs": doc.astype(np.int32),
        "tf": tf.astype(np.int32),
        "edges": np.searchsorted(term[edge], np.arange(len(names) + 1)).astype(np.int64),
        "edge_tf": tf[edge].astype(np.int32),
        "edge_n": n[doc[edge]].astype(np.int32),
    }


def _write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    import zstandard

    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with open_fs(uri)[0].open_output_stream(open_fs(uri)[1], compression=None) as f:
        f.write(zstandard.ZstdCompressor(level=1).compress(buffer.getvalue()))


def _read(uri: str) -> dict[str, np.ndarray]:
    import zstandard

    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        raw = zstandard.ZstdDecompressor().decompress(f.read())
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


class _Names(Sequence):
    """The sorted terms of a shard, cut out of their bytes when asked for."""

    def __init__(self, shard: dict[str, np.ndarray]):
        self.raw, self.ends = shard["names"].tobytes(), shard["ends"]

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, k: int) -> bytes:
        return self.raw[self.ends[k - 1] if k else 0 : self.ends[k]]


class Shard:
    """One shard under search: lists by term with their greatest share, each worked out once."""

    def __init__(self, arrays: dict[str, np.ndarray], docs: int, total: int):
        self.a, self.docs, self.total = arrays, docs, total
        self.names = _Names(arrays)
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray, int] | None] = {}

    def bounded(self, term: bytes) -> tuple[slice, int] | None:
        """Where a term's list lies, and its greatest share."""
        if term not in self.lists:
            k = bisect_left(self.names, term)
            found = None
            if k < len(self.names) and self.names[k] == term:
                e = slice(self.a["edges"][k], self.a["edges"][k + 1])
                most = int(share(self.a["edge_tf"][e], self.a["edge_n"][e], self.docs, self.total).max())
                found = [slice(self.a["starts"][k], self.a["starts"][k + 1]), most, None]
            self.lists[term] = found
        return self.lists[term]

    def postings(self, held: list) -> tuple[np.ndarray, np.ndarray]:
        if held[2] is None:
            docs = self.a["docs"][held[0]]
            held[2] = docs, share(self.a["tf"][held[0]], self.a["n"][docs], self.docs, self.total)
        return held[2]


def max_score(shard: Shard, query: list[tuple[bytes, int]], k: int, floor: int, watch=None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among the k best with at least ``floor`` points, for weighted terms.

    Lists are taken by falling upper bound. As long as those left can lift a document past the threshold on their own they are essential: every document in them
    is scored. Once they can't, the rest is non-essential: it is only looked up for documents seen, and only while one's points and the bounds left
    reach the threshold, which rises with the k-th best points so far. ``watch`` is told (essential lists, lists, documents seen, documents left).
    """
    lists = [(weight * held[1], weight, held) for term, weight in query if (held := shard.bounded(term)) is not None]
    lists.sort(key=lambda x: -x[0])
    left = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0).astype(np.int64)
    points = np.zeros(len(shard.a["ids"]), np.int64)
    threshold = max(floor, 1)

    def risen(some: np.ndarray) -> int:
        return max(threshold, int(np.partition(some, len(some) - k)[len(some) - k])) if len(some) >= k else threshold

    at = 0
    while at < len(lists) and left[at] >= threshold:
        docs, shares = shard.postings(lists[at][2])
        points[docs] += lists[at][1] * shares
        at += 1
        threshold = risen(points)
    seen = int(np.count_nonzero(points)) if watch is not None else 0
    essential = at
    possible = np.flatnonzero((points > 0) & (points + left[at] >= threshold))
    while at < len(lists) and len(possible):
        docs, shares = shard.postings(lists[at][2])
        where = np.minimum(np.searchsorted(docs, possible), len(docs) - 1)
        hit = docs[where] == possible
        points[possible[hit]] += lists[at][1] * shares[where[hit]]
        at += 1
        threshold = risen(points[possible])
        possible = possible[points[possible] + left[at] >= threshold]
    if watch is not None:
        watch(essential, len(lists), seen, len(possible))
    return possible, points[possible]


def best_of(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """The k best: highest score, then smaller id, then those without an id."""
    return np.lexsort((ids, no_id, -scores))[:k]


INDEX = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("terms", pa.int64()), ("term", pa.binary()), ("df", pa.int64())])
ASKED = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])
HIT = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def build_index(docs: DataFrame, where: str, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the inverted index of whole texts as shard files; return and save what is in them.

    One row for each shard (file, docs, terms) and one for each of its terms (term, df). Texts stay where they are read: consecutive documents of a task make a
    shard, nothing is shuffled. A task names its files anew in every attempt; only those in the saved table count. Null texts and texts without a term aren't in the index.
    """

    def work(batches):
        fs, folder = open_fs(where)
        fs.create_dir(folder, recursive=True)
        filling = Filling()

        def close():
            shard = build_shard(filling)
            uri = f"{where}/{uuid.uuid4().hex}.shard"
            _write(uri, shard)
            yield rows_to_batch(INDEX, [[uri], [len(filling.ids)], [int(shard["n"].sum())], [None], [None]])
            names, df = _Names(shard), np.diff(shard["starts"])
            for a in range(0, len(names), 1 << 16):
                b = min(a + (1 << 16), len(names))
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.string()), none, none, pa.array([names[k] for k in range(a, b)], pa.binary()), pa.array(df[a:b], pa.int64())], schema=INDEX)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(body.as_py())
                if not words:
                    continue
                filling.add(doc_id, words)
                if filling.size >= shard_bytes:
                    yield from close()
                    filling = Filling()
        if filling.ids:
            yield from close()

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return save(body.mapInArrow(work, "file string, docs long, terms long, term binary, df long"), where + "/index")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, where: str | None = None) -> DataFrame:
    """The k best documents (doc_id, text) with points for each item (item_id, text): item_id, rank, doc_id, score.

    Texts are indexed in shards. N, L and the document frequencies of the items' terms come from the index, over all documents. Items, with the weights of
    their terms, are written in blocks; a block meets shards in groups, both read by reference, and hands its k-th best score from shard to shard, so later
    ones only look for better. A group returns at most k documents for an item.

    Null and empty texts have no terms: as documents they count nowhere, as items they find nothing. Equal scores are ranked by doc_id, documents without an id after the others; repeated
    document rows are documents of their own, repeated item rows are answered each, and an item without an id too, under null. Whole texts count, however long; empty tables
    give no rows; other columns, whatever their names, are not read. Points must fit 64 bits.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "lexical")
    index = build_index(docs, where + "/shards")
    shards = index.filter("file is not null")
    size = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l"), F.count(F.lit(1)).alias("shards")).first()
    n_docs, total = size["n"], max(1, size["l"])

    def ask(batches):
        for batch in batches:
            rows = [(item, item_id, t, times) for item, item_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) for t, times in Counter(terms_of(body.as_py())).items()]
            if rows:
                yield rows_to_batch(ASKED, list(zip(*rows)))

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = save(numbered.mapInArrow(ask, "item long, item_id long, term binary, times long"), where + "/asked")
    frequency = index.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = asked.join(frequency, "term").select("item", "item_id", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0")
    n_items = asked.agg(F.count_distinct("item")).first()[0]
    blocks = max(1, -(-n_items // ITEMS))
    ref = pa.schema([("block", pa.string())])

    def write_block(table: pa.Table) -> pa.Table:
        fs, folder = open_fs(where + "/blocks")
        fs.create_dir(folder, recursive=True)
        uri = f"{where}/blocks/{uuid.uuid4().hex}"
        with fs.open_output_stream(open_fs(uri)[1], compression=None) as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)
        return pa.table([pa.array([uri])], schema=ref)

    each = weighted.withColumn("_block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    written = save(each.groupBy("_block").applyInArrow(lambda table: write_block(table.select(["item", "item_id", "term", "weight"])), "block string"), where + "/asked-blocks")
    groups = max(1, -(-size["shards"] // GROUP))
    dealt = shards.groupBy(F.pmod(F.xxhash64("file"), F.lit(groups)).alias("group")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    pairs = written.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(dealt.hint("merge"), "group")
    pairs = pairs.repartition(partitions(spark), "group", F.xxhash64("block")).sortWithinPartitions("group")

    def queries_of(uri: str) -> dict[tuple[int, int | None], list[tuple[bytes, int]]]:
        fs, path = open_fs(uri)
        with fs.open_input_stream(path, compression=None) as f:
            table = pa.ipc.open_file(pa.BufferReader(f.read())).read_all()
        out: dict = {}
        for item, item_id, term, w in zip(*(c.to_pylist() for c in table.columns)):
            out.setdefault((item, item_id), []).append((term, w))
        return out

    def search(batches):
        held: dict[str, Shard] = {}
        for batch in batches:
            for block, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                queries = queries_of(block)
                best = {key: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for key in queries}
                for uri in files:
                    if uri not in held:
                        while len(held) >= HELD:
                            held.pop(next(iter(held)))
                        held[uri] = Shard(_read(uri), n_docs, total)
                    shard = held[uri]
                    for key, query in queries.items():
                        scores, ids, no_id = best[key]
                        found, points = max_score(shard, query, k, int(scores[-1]) if len(scores) >= k else 1)
                        if len(found):
                            scores, ids, no_id = np.append(scores, points), np.append(ids, shard.a["ids"][found]), np.append(no_id, shard.a["no_id"][found])
                            top = best_of(scores, ids, no_id, k)
                            best[key] = scores[top], ids[top], no_id[top]
                rows = [(item, item_id, None if none else int(i), int(s)) for (item, item_id), (scores, ids, no_id) in best.items() for s, i, none in zip(scores, ids, no_id)]
                if rows:
                    yield rows_to_batch(HIT, list(zip(*rows)))

    hits = pairs.select("block", "files").mapInArrow(search, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
