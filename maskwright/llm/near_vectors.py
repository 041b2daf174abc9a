"""Near-duplicate vectors by a pivot-permutation index: inverted pivot lists, shared-pivot counts, exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_commonest, rows_to_batch, save, shared_dir, tasks_for
from .components import connected_components

#: Production parameters: least cosine of a link.
LEAST_COSINE = 0.98
#: Reference points: about the root of the number of distinct vectors, within these bounds; the bounded sample that they and their order are fitted on.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 256, 16_384, 4_096
#: Nearest reference points that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 10, 4
#: Vectors of a list that are compared at once; a longer list is met in pairs of blocks of this size.
BLOCK = 2_048
#: Most long lists whose sizes go to every task; more are met by a shuffled join.
MOST_LONG = 200_000

ROW = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("label", pa.string()), ("dims", pa.int32()), ("x", pa.binary())])
ROW_SQL = "vec_id long, key binary, label string, dims int, x binary"
FOUND = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def usable(values) -> np.ndarray | None:
    """The vector in double, scaled by a power of two so that no square leaves the range; None if it can't have a cosine."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0


def _stack(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_for(n: int) -> int:
    """Reference points for so many distinct vectors: the power of two next to the root."""
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, 1 << round(np.log2(max(n, 1)) / 2)))


def fitted(pivots: np.ndarray, dims: int) -> np.ndarray:
    """Unit reference points cut or filled with zeros to so many components; any direction serves, so one without length is the first axis."""
    out = np.zeros((len(pivots), dims))
    out[:, : min(dims, pivots.shape[1])] = pivots[:, :dims]
    out[~out.any(axis=1), 0] = 1.0
    return _unit(out)


def nearest(x: np.ndarray, points: np.ndarray, m: int = NEAREST) -> np.ndarray:
    """Numbers of the m nearest reference points of each row, nearest first, ties to the smaller number."""
    m = min(m, len(points))
    out = np.empty((len(x), m), np.int32)
    step = max(1, (1 << 22) // len(points))
    for a in range(0, len(x), step):
        s = _unit(x[a : a + step]) @ points.T
        some = np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1)
        order = np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable")
        out[a : a + step] = np.take_along_axis(some, order, 1)
    return out


def apart(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """Up to n vectors of the sample, in order, of which no two have a cosine of ``least`` or more."""
    unit, chosen = _unit(sample), []
    held = np.empty((n, sample.shape[1]))
    for k, x in enumerate(unit):
        if len(chosen) < n and not (held[: len(chosen)] @ x >= least).any():
            held[len(chosen)] = x
            chosen.append(k)
    return sample[chosen]


def ordered_pivots(sample: np.ndarray, n: int, least: float = LEAST_COSINE) -> np.ndarray:
    """Up to n vectors of the sample as reference points, those near fewest vectors of the sample first.

    Points stand apart by twice the angle of a link, so that linked vectors can't have wholly different neighbours among them; where that leaves few, by that angle.
    """
    points = apart(sample, n, 2 * least * least - 1)
    if len(points) < LEAST_PIVOTS // 4:
        points = apart(sample, n, least)
    count = np.bincount(nearest(sample, _unit(points)).ravel(), minlength=len(points))
    return points[np.argsort(count, kind="stable")]


def compare(pivot: int, left: dict, right: dict | None, least: float = LEAST_COSINE, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, links, roots): what the pairs inside a block of one pivot's list, or between two blocks, are linked to.

    Pairs are retrieved by how many reference points both descriptions have, and only under the first one that they share, so each meets once. Those
    retrieved are verified by cosine in double. Counts, weighed with copies, and the least vector that each hangs together with are returned instead of pairs.
    """
    rows = left if right is None else {k: np.concatenate([left[k], right[k]]) for k in left}
    n, cut = len(rows["cls"]), len(left["cls"])
    known, at = np.unique(rows["pivots"], return_inverse=True)
    marks = np.zeros((n, len(known)), np.float32)
    marks[np.arange(n)[:, None], at.reshape(n, -1)] = 1
    first = int(np.searchsorted(known, pivot))
    a, b = (slice(0, n), slice(0, n)) if right is None else (slice(0, cut), slice(cut, n))
    retrieved = (marks[a] @ marks[b].T >= shared) & (marks[a, :first] @ marks[b, :first].T == 0)
    x, size = rows["x"], np.linalg.norm(rows["x"], axis=1)
    linked = retrieved & (x[a] @ x[b].T >= least * np.outer(size[a], size[b]))
    if right is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    i, j = i + (a.start or 0), j + b.start
    links = np.bincount(i, weights=rows["copies"][j], minlength=n) + np.bincount(j, weights=rows["copies"][i], minlength=n)
    root = rows["cls"].copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(links)
    return rows["cls"][some], links[some].astype(np.int64), root[some]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = LEAST_COSINE, where: str | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable by links) and kept (the one that stays).

    Vectors of equal ``group`` and length link when their cosine is at least ``least``. Equal vectors of a group are one class. The ``NEAREST`` reference points of every
    class, in order of nearness, describe it; each point has an inverted list of those that it describes. Two that share ``SHARED`` points share one of the first
    ``NEAREST - SHARED + 1`` of each in any fixed order, so only those lists, rarest points first, are kept. Lists are parted by group; within one, shared points are counted, and pairs with enough are
    verified. A longer list meets itself block by block, so no task holds more than two blocks and no pair is written. Pairs that share fewer points are not found:
    ``tests`` and the README have the recall. Reference points and their order are fitted on a bounded sample, the index holds every row.

    A vector that is null, empty or zero, or holds null or non-finite components, and one whose group is null, links with nothing and is kept. So does a row without an id, whose component_id
    is null. Repeated ids are vectors of their own and link as others do; vectors of different length never link. An empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    spark = vectors.sparkSession
    where = where or shared_dir(spark, "near")

    def read(batches):
        for batch in batches:
            out = []
            for vec_id, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = usable(values.as_py()) if vec_id is not None and label is not None else None
                if x is None:
                    out.append((vec_id, None, None, None, None))
                    continue
                raw = x.tobytes()
                out.append((vec_id, hashlib.blake2b(raw + label.encode("utf-8"), digest_size=16, salt=len(x).to_bytes(8, "little")).digest(), label, len(x), raw))
            if out:
                yield rows_to_batch(ROW, list(zip(*out)))

    body = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group).cast("string").alias("label"), F.col(vector).alias("x"))
    rows = save(body.mapInArrow(read, ROW_SQL), where + "/rows")
    same = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "dims", "x")).alias("v"))
    classes = save(same.withColumn("cls", F.monotonically_increasing_id()).select("key", "cls", "least_id", "copies", "v.*"), where + "/classes")
    total = classes.count()
    n_pivots = pivots_for(total)
    sample = [usable(np.frombuffer(r["x"], np.float64)) for r in classes.orderBy("key").select("x").limit(max(SAMPLE, n_pivots)).collect()]
    longest = max((len(x) for x in sample), default=1)
    held = np.zeros((len(sample), longest))
    for k, x in enumerate(sample):
        held[k, : len(x)] = x
    points_of = ordered_pivots(held, n_pivots, least) if len(held) else np.ones((1, 1))
    spread, shared = spark.sparkContext.broadcast(points_of), min(SHARED, len(points_of))
    described_schema = pa.schema([("cls", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("copies", pa.int64()), ("x", pa.binary()), ("pivots", pa.list_(pa.int32()))])

    def describe(batches):
        points: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                if d not in points:
                    points = {int(d): fitted(spread.value, int(d))}
                some = pa.array(np.flatnonzero(dims == d))
                part = batch.take(some)
                at = nearest(_stack(part.column(4).to_pylist()), points[int(d)])
                yield rows_to_batch(described_schema, [*part.columns, list(at)])

    described = save(classes.select("cls", "label", "dims", "copies", "x").mapInArrow(describe, "cls long, label string, dims int, copies long, x binary, pivots array<int>"), where + "/described")
    listed = described.withColumn("pivot", F.explode(F.slice(F.array_sort("pivots"), 1, NEAREST - SHARED + 1)))
    of = ["label", "dims", "pivot"]
    long = save(listed.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), where + "/long")
    hinted = F.broadcast(long) if long.count() <= MOST_LONG else long
    parted = listed.join(hinted, of, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = parted.withColumn("block", F.pmod(F.xxhash64("cls", "pivot"), F.col("blocks")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    task = [*of, "lo", "hi"]
    dealt = met.select(*task, "block", "cls", "copies", "x", "pivots").repartition(tasks_for(spark, 8 * total * 600), *task).sortWithinPartitions(*task, "cls")

    def rows_of(batch: pa.RecordBatch) -> dict:
        return {"cls": batch.column(6).to_numpy(), "copies": batch.column(7).to_numpy(), "x": _stack(batch.column(8).to_pylist()), "pivots": np.array(batch.column(9).to_pylist(), np.int32), "block": batch.column(5).to_numpy()}

    def work(batches):
        held: list[dict] = []
        key = None

        def close():
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            at = rows.pop("block")
            part = lambda block: {k: v[at == block] for k, v in rows.items()}
            if len(at) < 2:
                return None
            found = compare(key[2], rows, None, least, shared) if key[3] == key[4] else compare(key[2], part(key[3]), part(key[4]), least, shared)
            return rows_to_batch(FOUND, found) if len(found[0]) else None

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    if held and (out := close()) is not None:
                        yield out
                    held, key = [], keys[a]
                held.append(rows_of(batch.slice(a, b - a)))
        if held and (out := close()) is not None:
            yield out

    found = save(dealt.mapInArrow(work, "cls long, links long, root long"), where + "/found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), where + "/cc")
    inside = save(classes.select("cls", "least_id").join(reached.withColumnRenamed("node", "cls"), "cls").select("cls", "least_id", "component"), where + "/inside")
    least_of = save(inside.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), where + "/least")
    placed = join_commonest(inside.select("cls", "component"), least_of, "component", "members", "cls").drop("component")
    told = save(
        classes.select("key", "cls", "least_id", "copies").join(links, "cls", "left").join(placed, "cls", "left")
        .select("key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")),
        where + "/told",
    )
    out = join_commonest(rows.select("vec_id", "key"), told, "key", "copies", "vec_id")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
