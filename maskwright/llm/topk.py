"""Exact top-k inner products by an impact-ordered index, processed score at a time."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, partitions, rows_to_batch, save, shared_dir

#: Production parameters.
SCALE = 64
K = 20
EVERY = 20
SHARD_VECTORS = 8192
QUERY_BLOCK = 128
#: Distinct quantised impacts of a dimension in a shard; more values share a level.
LEVELS = 256
#: Impacts of a query's segments are quantised to so many levels; the proof is tried after each of them.
BANDS = 32
#: A walk ends when no more than this share of the shard may still be among the best; those are rescored.
RESCORE = 0.02
#: Vectors of a shard whose bounds say when a proof is worth a try.
PROBES = 64
#: Shards that a query block meets one after another, handing on its k-th best score.
GROUP = 8
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(**arrays) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def _unpack(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def build_shard(ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS) -> dict:
    """Postings of a shard by (dimension, level), with each segment's bounds; ``rows`` stays for rescoring.

    Impacts share a level when they agree above ``shift`` bits, the least shift that leaves a
    dimension at most ``levels`` levels; without a shift a level is one exact impact. Within a dimension levels rise.
    """
    n, dims = rows.shape
    order, starts, low, high, count = [], [], [], [], []
    at = 0
    for d in range(dims):
        v = rows[:, d]
        shift = 0
        while len(np.unique(v >> shift)) > levels:
            shift += 1
        by = np.lexsort((np.arange(n), v >> shift))
        level = (v >> shift)[by]
        first = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        order.append(by)
        starts.append(at + first)
        low.append(np.minimum.reduceat(v[by], first))
        high.append(np.maximum.reduceat(v[by], first))
        count.append(len(first))
        at += n
    return opened(
        {
            "ids": ids,
            "rows": rows,
            "postings": np.concatenate(order).astype(np.int32),
            "starts": np.append(np.concatenate(starts), at).astype(np.int64),
            "low": np.concatenate(low),
            "high": np.concatenate(high),
            "count": np.array(count, np.int64),
        }
    )


#: What a shard's file holds; the rest is worked out by ``opened``.
STORED = ("ids", "rows", "postings", "starts", "low", "high", "count")


def opened(shard: dict) -> dict:
    """The shard with what a walk needs beside the stored parts: each segment's dimension and size, and the segments of a few vectors spread over the shard."""
    rows, starts, postings = shard["rows"], shard["starts"], shard["postings"].astype(np.int64)
    n, dims = rows.shape
    dim, size = np.repeat(np.arange(dims), shard["count"]), np.diff(starts)
    probes = np.unique(np.linspace(0, n - 1, PROBES).astype(np.int64))
    met = np.empty((dims, n), np.int64)
    met[np.repeat(np.arange(dims), n), postings] = np.repeat(np.arange(len(dim)), size)
    return shard | {
        "postings": postings,
        "low": shard["low"].astype(np.float64),
        "high": shard["high"].astype(np.float64),
        "dim": dim,
        "size": size,
        "met": met.T[probes],
    }


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by descending score, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Levels:
    """A query's ``BANDS`` levels of falling quantised impact in a shard.

    A segment's impact is the greatest magnitude of a product of query and vector component in it, ``greatest`` the greatest product. Levels are equally wide
    in the impact's root, which parts small impacts, the most, finer than great ones. ``seen`` counts the postings up to a level's end; ``bounds`` are those of the
    shard's probes there, which only say when a proof is worth a try.
    """

    def __init__(self, shard: dict, query: np.ndarray):
        dims = len(query)
        q = query.astype(np.float64)[shard["dim"]]
        a, b = q * shard["low"], q * shard["high"]
        self.greatest = np.maximum(a, b)
        self.impact = np.maximum(self.greatest, -np.minimum(a, b))
        self.largest = float(self.impact.max(initial=0))
        root = np.sqrt(self.impact)
        top, bottom = root.max(initial=0), root.min(initial=np.inf)
        width = max((top - bottom) / BANDS, 1e-9)
        self.level = np.minimum((top - root) * (1 / width), BANDS - 1).astype(np.int64)
        self.seen = np.bincount(self.level, weights=shard["size"], minlength=BANDS).cumsum()
        met, m = shard["met"], len(shard["met"])
        at = (self.level[met] + BANDS * np.arange(m)[:, None]).ravel()
        sums, counts = (np.bincount(at, weights=x, minlength=m * BANDS).reshape(m, BANDS).cumsum(axis=1) for x in (self.greatest[met].ravel(), None))
        self.bounds = sums + (dims - counts) * np.square(np.maximum(top - width * np.arange(1, BANDS + 1), 0))


def search(shard: dict, query_id: int, query: np.ndarray, k: int, floor: int, watch=None) -> tuple[np.ndarray, np.ndarray]:
    """The shard's k best for a query, at least ``floor``, as (ids, scores).

    Segments are taken level by level of falling quantised impact (``Levels``). A vector's bound is the sum of the segments' greatest products seen plus, for every
    dimension not yet seen for it, the greatest product left. The walk ends when the bounds prove that all but a few vectors are below the k-th best
    score known; those few, and only those, are rescored exactly. A walk without proof ends with the last posting. A proof is tried after each level where the bounds of the
    shard's probes promise one, and after half of the postings, to raise the k-th best score, if no level does; levels between are added up together, in the order of their postings in memory, where
    segments of neighbouring levels are neighbours. ``watch`` is told each level's impacts and how many vectors stay possible.
    """
    ids, rows, starts, postings, size = (shard[x] for x in ("ids", "rows", "starts", "postings", "size"))
    n, dims = rows.shape
    levels = Levels(shard, query)
    # what the sums in double may lack against exact ones
    slack = dims * levels.largest * dims * 2.0**-52
    other = ids != query_id
    # products are whole numbers: where sum and count fit one double exactly, a posting adds its product and a unit for the count
    unit = 2.0 ** np.ceil(np.log2(4 * dims * levels.largest + 4))
    packed = 2 * dims * unit < 2.0**53
    total, seen = np.zeros(n), np.zeros(n)
    members = np.flatnonzero(other)

    def score(some: np.ndarray) -> np.ndarray:
        return rows[some].astype(np.int64, copy=False) @ query

    few = lambda: (levels.bounds >= floor).sum(axis=0) <= RESCORE * len(levels.bounds)
    promising, tried, done = few(), False, -1
    for b in range(BANDS):
        due = promising[b] or b == BANDS - 1 or not tried and 2 * levels.seen[b] >= n * dims and not promising[:-1].any()
        seg = np.flatnonzero((levels.level > done) & (levels.level <= b)) if due else ()
        if len(seg):
            weights = np.repeat(levels.greatest[seg] + unit if packed else levels.greatest[seg], size[seg])
            cut = np.flatnonzero(np.diff(seg, prepend=-2) != 1)
            used = 0
            for x, z in zip(starts[seg[cut]].tolist(), starts[seg[np.append(cut[1:], len(seg)) - 1] + 1].tolist()):
                np.add.at(total, postings[x:z], weights[used : used + z - x])
                if not packed:
                    np.add.at(seen, postings[x:z], 1.0)
                used += z - x
            done, left = b, levels.greatest[levels.level > b].max(initial=-np.inf)
            if packed:
                seen = np.rint(total * (1 / unit))
            upper = total - seen * unit if packed else total
            if left > -np.inf:
                upper = upper + (dims - seen) * left
            if not tried:
                tried = True
                likely = np.argpartition(-upper, min(2 * k, n - 1))[: 2 * k]
                exact = score(likely[other[likely]])
                if len(exact) >= k:
                    floor = max(floor, int(np.partition(exact, len(exact) - k)[len(exact) - k]))
                    promising = few()
            members = np.flatnonzero(other & (upper + slack >= floor))
        if watch is not None and (levels.level == b).any():
            watch(b, levels.impact[levels.level == b], len(members))
        if len(members) <= max(k, RESCORE * n):
            break
    scores = score(members)
    members, scores = members[scores >= floor], scores[scores >= floor]
    found = best(ids[members], scores, k)
    return ids[members[found]], scores[found]


def search_block(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """``search`` of each query of a block; ``floor`` is raised where the shard has k better ones."""
    out = []
    floor = np.full(len(query_ids), np.iinfo(np.int64).min) if floor is None else floor
    for j in range(len(query_ids)):
        found, scores = search(shard, query_ids[j], queries[j], k, int(floor[j]))
        if len(scores) >= k:
            floor[j] = max(floor[j], int(scores[k - 1]))
        out.append((found, scores))
    return out


class Shards:
    """Reads shard files by reference and keeps the latest few."""

    def __init__(self, keep: int = GROUP):
        self.keep, self.held = keep, {}

    def get(self, uri: str) -> dict:
        if uri not in self.held:
            if len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            fs, path = open_fs(uri)
            with fs.open_input_stream(path, compression=None) as f:
                self.held[uri] = opened(_unpack(f.read()))
        return self.held[uri]


def quantise(embedding, scale: int) -> np.ndarray | None:
    """floor(scale * x) of every component as double, or None if one is null or not finite."""
    if embedding is None:
        return None
    x = np.array([np.nan if v is None else v for v in embedding], np.float64)
    return np.floor(scale * x).astype(np.int64) if np.isfinite(x).all() else None


def _matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    keep, rows = [], []
    for k, v in enumerate(column):
        row = quantise(v.as_py(), scale)
        if row is not None:
            keep.append(k)
            rows.append(row)
    return np.array(keep, np.int64), rows


def _rectangle(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, where: str | None = None) -> DataFrame:
    """For each query (ids divisible by ``every``) its k best other vectors: query_id, rank, vec_id, score.

    Vectors are dealt to shards by hash of id, and each shard's index is a file. A block of queries meets the shards in groups: it reads them
    by reference, one after another, and hands its k-th best score on. A shard returns at most k rows for a query, and the best of those are kept. Vectors that are null or hold null or
    non-finite components, and null ids, take no part; shorter vectors count as ending in zeros, so an empty one scores 0. Every row of a repeated id is a
    vector, no row with the query's id is its candidate, and queries repeated by id are answered for each distinct vector
    once (rows of ties that agree in id and score keep one rank each). An empty table gives no rows; other columns, whatever their names, are not
    read. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    where = where or shared_dir(spark, "topk")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).filter("vec_id is not null and embedding is not null")
    size = source.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    shards, dims = max(1, -(-size["n"] // SHARD_VECTORS)), max(1, size["d"] or 1)

    refs = pa.schema([("shard", pa.int64()), ("file", pa.string())])

    def index(table: pa.Table) -> pa.Table:
        keep, rows = _matrix(table.column("embedding").combine_chunks(), scale)
        if not len(keep):
            return refs.empty_table()
        shard = table.column("shard")[0].as_py()
        fs, folder = open_fs(where)
        fs.create_dir(folder, recursive=True)
        uri = f"{where}/shard-{shard}-{uuid.uuid4().hex}"  # a new name in every attempt; the saved table names those that count
        with fs.open_output_stream(open_fs(uri)[1], compression=None) as f:
            built = build_shard(table.column("vec_id").to_numpy()[keep], _rectangle(rows, dims))
            f.write(_pack(**{x: built[x] for x in STORED}))
        return pa.table([pa.array([shard], pa.int64()), pa.array([uri])], schema=refs)

    dealt = source.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    built = save(dealt.groupBy("shard").applyInArrow(index, "shard long, file string"), where + "/index")

    def blocks(batches):
        ids: list[int] = []
        rows: list[np.ndarray] = []
        schema = pa.schema([("block", pa.binary())])
        for batch in batches:
            keep, new = _matrix(batch.column(1), scale)
            ids += batch.column(0).to_numpy()[keep].tolist()
            rows += new
            while len(ids) >= QUERY_BLOCK:
                yield rows_to_batch(schema, [[_pack(ids=np.array(ids[:QUERY_BLOCK], np.int64), rows=_rectangle(rows[:QUERY_BLOCK], dims))]])
                ids, rows = ids[QUERY_BLOCK:], rows[QUERY_BLOCK:]
        if ids:
            yield rows_to_batch(schema, [[_pack(ids=np.array(ids, np.int64), rows=_rectangle(rows, dims))]])

    asked = save(source.filter(F.col("vec_id") % every == 0).mapInArrow(blocks, "block binary"), where + "/queries")
    groups = built.groupBy(F.floor(F.col("shard") / GROUP).alias("group")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // GROUP).cast("long")))
    pairs = asked.withColumn("group", each).join(groups.hint("merge"), "group")
    pairs = pairs.repartition(partitions(spark), "group", F.xxhash64("block")).sortWithinPartitions("group")

    def search_all(batches):
        held = Shards()
        for batch in batches:
            for raw, files in zip(batch.column(0), batch.column(1).to_pylist()):
                block = _unpack(raw.as_py())
                floor = np.full(len(block["ids"]), np.iinfo(np.int64).min)
                for uri in files:
                    out = [[], [], []]
                    for query_id, (found, scores) in zip(block["ids"].tolist(), search_block(held.get(uri), block["ids"], block["rows"], k, floor)):
                        out[0].append(np.full(len(found), query_id))
                        out[1].append(found)
                        out[2].append(scores)
                    yield rows_to_batch(OUT, [np.concatenate(x).astype(np.int64) for x in out])

    found = pairs.select("block", "files").mapInArrow(search_all, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
