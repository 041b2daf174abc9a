"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Fetcher, write_blocks
from .common import join_commonest, partitions, remove, rows_to_batch, save, shared_dir
from .components import connected_components

#: Slots of the frequency table by which n-grams are ordered: one for so many bytes of text, within these bounds; 4 bytes each in every Python worker.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 512, 1 << 18, 1 << 22
CHUNK = 1 << 14
#: Hash ranges by which the suffix filter parts a set, a power of two: with few of them, elements that differ hide in one range.
PARTS = 64
#: Independent minima by which likely links are tried first.
MINIMA = 4
#: Passes of the prefix join: with one member of an n-gram's commonest component each, and at last with all.
TURNS = ("one", "two", "all")

_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _tables():
    byte = _mix(np.arange(1, 257, dtype=np.uint64) * _M)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return byte[lower], blank


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    p = np.full(n, _M, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def ngram_hashes(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every word n-gram of texts laid end to end in UTF-8 ``data``.

    A-Z count as lower case. A text with fewer than ``width`` words has its whole sequence as one n-gram.
    """
    byte, blank = _tables()
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    at = np.flatnonzero(~blank[data])
    if not len(at):
        return none
    begins = np.concatenate([[0], ends[:-1]])
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1] + 1
    first = np.searchsorted(at, begins[begins < len(data)])
    new[first[first < len(at)]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    inside = np.arange(len(at)) - np.repeat(start, size)
    word = np.add.reduceat(byte[data[at]] * _powers(1 << int(inside.max() + 1).bit_length())[inside], start)
    word = _mix(word + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    doc = np.searchsorted(ends, at[start], side="right")
    n_words = np.bincount(doc, minlength=len(ends))
    n_grams = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    word_from = np.cumsum(n_words) - n_words
    gram_doc = np.repeat(np.arange(len(ends)), n_grams)
    gram_from = np.cumsum(n_grams) - n_grams
    w0 = word_from[gram_doc] + np.arange(len(gram_doc)) - gram_from[gram_doc]
    h = np.zeros(len(gram_doc), np.uint64)
    for j in range(width):
        has = n_words[gram_doc] > j
        value = np.where(has, word[np.minimum(w0 + j, len(word) - 1)], _U(0))
        h = _mix(h * _M + value + _U(j + 1))
    return gram_doc, h


def text_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text."""
    raw = np.frombuffer(data, np.uint8)
    return np.unique(ngram_hashes(raw, np.array([len(raw)]), width)[1])


def _sets(column, width: int):
    """Sorted distinct hashes of each text of an Arrow column, about a megabyte at a time."""
    texts = [(v.as_py() or "").encode("utf-8") for v in column]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 1 << 20):
            size += len(texts[upto])
            upto += 1
        ends = np.cumsum([len(t) for t in texts[at:upto]])
        doc, h = ngram_hashes(np.frombuffer(b"".join(texts[at:upto]), np.uint8), ends, width)
        bounds = np.searchsorted(doc, np.arange(upto - at + 1))
        for k in range(upto - at):
            yield np.unique(h[bounds[k] : bounds[k + 1]])
        at = upto


def least_overlap(n: int, percent: int) -> int:
    """Fewest common elements that a set of n must have with any partner: percent of the union, at least n."""
    return -(-percent * n // 100)


def slots_for(n_bytes: int) -> int:
    return 1 << max(LEAST_SLOTS, min(MOST_SLOTS, n_bytes // SLOT_BYTES)).bit_length() - 1


def frequency_slots(docs: DataFrame, width: int, slots: int, text: str = "text") -> np.ndarray:
    """How many documents' n-grams fall in each slot, over all texts: n-grams commoner than a slot's usual load are told from rare ones."""

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(slots, np.int64)
        for batch in batches:
            held, size = [], 0
            for s in [*_sets(batch.column(0), width), None]:
                if s is not None:
                    held.append(s)
                    size += len(s)
                if held and (s is None or size > slots):
                    np.add.at(total, (np.concatenate(held) & _U(slots - 1)).astype(np.int64), 1)
                    held, size = [], 0
        salt = TaskContext.get().partitionId() % 32
        chunks = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(-1, CHUNK)
        schema = pa.schema([("chunk", pa.int64()), ("salt", pa.int64()), ("counts", pa.binary())])
        yield rows_to_batch(schema, [list(range(len(chunks))), [salt] * len(chunks), [c.tobytes() for c in chunks]])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int32)
        counts = np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()), "counts": pa.array([counts], pa.binary())})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "chunk long, salt long, counts binary")
    once = parts.groupBy("chunk", "salt").applyInArrow(add, "chunk long, counts binary")
    rows = once.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    out = np.zeros((slots // CHUNK, CHUNK), np.int32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


SIGNS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("class_key", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int8())), ("wide", pa.list_(pa.int16())), ("minima", pa.list_(pa.int64()))])
SIGNS_SQL = "doc_id long, mark long, class_key binary, n long, prefix array<long>, parts array<tinyint>, wide array<smallint>, minima array<long>"


def signatures(docs: DataFrame, slots: np.ndarray, width: int, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: set size, a digest of the whole set, its rare-first prefix, sizes by hash range (``parts``, or ``wide`` where a byte is too small) and minima."""
    spread = docs.sparkSession.sparkContext.broadcast(slots)
    turns = [_U(int.from_bytes(hashlib.sha256(b"minimum%d" % k).digest()[:8], "little") | 1) for k in range(MINIMA)]

    def work(batches):
        count = spread.value
        for batch in batches:
            rows = []
            for doc_id, mark, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch.column(1), width)):
                n = len(s)
                if not n:
                    rows.append((doc_id, mark, None, 0, [], [], None, []))
                    continue
                length = n - least_overlap(n, percent) + 1
                parts = np.bincount((s >> _U(65 - PARTS.bit_length())).astype(np.int64), minlength=PARTS)
                by = np.lexsort((s, count[(s & _U(len(count) - 1)).astype(np.int64)]))[:length]
                rows.append((
                    doc_id,
                    mark,
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                    n,
                    s[by].view(np.int64),
                    parts.astype(np.int8) if parts.max() < 1 << 7 else None,
                    parts.astype(np.int16) if 1 << 7 <= parts.max() < 1 << 15 else None,  # neither: the suffix filter lets such a set pass
                    [int(_mix(s * t).min().view(np.int64)) for t in turns],
                ))
            if rows:
                yield rows_to_batch(SIGNS, list(zip(*rows)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("mark")).mapInArrow(work, SIGNS_SQL)


def verified(pairs: DataFrame, refs: DataFrame, blocks: str, width: int, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b), those whose sets overlap enough; each pair is compared once.

    Texts are fetched by reference, in block order, from the shared block files.
    """
    ref = lambda side: refs.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("block", "offset", "length")])
    with_refs = pairs.join(ref("a"), "a").join(ref("b"), "b")
    order = ["block_b", "offset_b", "block_a", "offset_a"]
    n = partitions(pairs.sparkSession)
    dealt = with_refs.repartition(n, "block_b", F.pmod(F.xxhash64("a"), F.lit(64))).sortWithinPartitions(*order)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        fetch = Fetcher(blocks, lambda data: text_set(data, width))
        for batch in batches:
            c = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            keep = []
            for k in range(batch.num_rows):
                x = fetch.get(c["block_a"][k], c["offset_a"][k], c["length_a"][k])
                y = fetch.get(c["block_b"][k], c["offset_b"][k], c["length_b"][k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield rows_to_batch(schema, [[c["a"][k] for k in keep], [c["b"][k] for k in keep]])

    return dealt.select("a", "b", "block_a", "offset_a", "length_a", "block_b", "offset_b", "length_b").mapInArrow(work, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text: str = "text", where: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links) and class_id.

    Documents link when the common n-grams are at least ``percent`` of all they have. Sets alike form a class, found by
    digest; its least document stands for it. Representatives that share a minimum are first
    compared with the least of them, which settles most of a large near-copy group without its pairs. The
    exact join then takes every n-gram of the rare-first prefixes and pairs only representatives of
    different components so far, through length, positional and suffix filters: twice with one member of the n-gram's commonest
    component, so that whoever belongs to a large group joins it by one link, and then, where components still differ, with all. Each pair is
    verified once. A link inside a component already found would change nothing, so none that matters is lost.

    Null and empty texts have 0 shingles and link with nothing, not even each other; their class_id is their own id. Repeated rows give
    repeated rows, and texts that share an id are told apart. A row without an id takes no part: its ids are null. A set is that of the whole text, however long; an empty table gives no rows; other
    columns, whatever their names, are not read. n-grams are compared by 64-bit hash within a pair.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "jaccard")
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    refs = write_blocks(body.filter("doc_id is not null"), where + "/blocks")
    total = refs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    slots = frequency_slots(body, width, slots_for(total))
    signs = save(signatures(body, slots, width, percent), where + "/signs")
    told = signs.filter("n > 0 and doc_id is not null")
    # a class is named by a number, as texts of one id may be of several classes; its least document and that text's hash find the text;
    # its documents have the same signature, so any of them gives it and prefixes are dealt and stored once
    of_set = ("n", "prefix", "parts", "wide", "minima")
    grouped = told.groupBy("class_key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in of_set])
    of_class = save(grouped.select("class_key", F.monotonically_increasing_id().alias("rep"), F.col("first.doc_id").alias("least_id"), F.col("first.mark").alias("mark"), "copies", *of_set), where + "/classes")
    keyed = signs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_key")).alias("class_key"), "n")
    members = save(join_commonest(keyed, of_class.select("class_key", "rep", "least_id", "copies"), "class_key", "copies", "doc_id").drop("class_key"), where + "/members")
    remove(spark, where + "/signs")
    named = of_class.select(F.col("least_id").alias("doc_id"), "mark", "rep")
    # below this size a set links with equal sets only
    least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 10_000
    reps = of_class.filter(F.col("n") >= least).select("rep", *of_set)
    met_refs = refs.select("doc_id", "mark", "block", "offset", "length").join(named, ["doc_id", "mark"]).dropDuplicates(["rep"])
    reps_refs = save(met_refs.select(F.col("rep").alias("doc_id"), "block", "offset", "length"), where + "/refs")

    keys = reps.select("rep", F.posexplode("minima").alias("k", "value")).select("rep", F.xxhash64("k", "value").alias("key"))
    leaders = save(keys.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1"), where + "/leaders")
    tried = join_commonest(keys, leaders, "key", "c", "rep").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sizes = reps.select("rep", "n")
    tried = tried.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    tried = save(tried.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), where + "/tried")
    early = save(verified(tried, reps_refs, where + "/blocks", width, percent), where + "/early")
    side = lambda df, s: df.select("gram", "major", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "pos", "n", "parts", "wide")])
    needed = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent))
    alike = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    full = lambda s: F.coalesce(F.col(f"wide_{s}"), F.col(f"parts_{s}").cast("array<smallint>"))
    common = F.coalesce(alike(F.col("parts_x"), F.col("parts_y")), alike(full("x"), full("y")))
    links, seen, met = early, tried, None
    for k, turn in enumerate(TURNS):
        before = save(connected_components(links, f"{where}/first-{turn}").withColumnRenamed("node", "rep"), f"{where}/before-{turn}")
        component = F.coalesce("component", "rep").alias("component")
        known = save(reps.select("rep", "n", "parts", "wide").join(before, "rep", "left").select("rep", "n", "parts", "wide", component), f"{where}/known-{turn}")
        if met is None:
            # most n-grams are in one component only; those that aren't are found in one deal of all postings
            every = reps.select("rep", "prefix").join(before, "rep", "left").select("rep", component, F.posexplode("prefix").alias("pos", "gram"))
            of_gram = Window.partitionBy("gram")
            ends = [f("component").over(of_gram).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))]
            postings = save(every.repartition(partitions(spark), "gram").select("*", *ends).filter("least <> most").drop("least", "most"), where + "/shared")
        else:  # components only grow together, so an n-gram that met one of them meets no more ever after
            postings = met.select("gram", "rep", "pos").join(known.select("rep", "component"), "rep")
        # an n-gram's commonest component is only met by the others, so a large group with one more document costs its size and not its square
        member = F.min_by("rep", F.xxhash64("rep", "gram", F.lit(turn))).alias("member")
        by = postings.repartition(partitions(spark), "gram").groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"), member)
        largest = F.max_by(F.struct(F.col("component").alias("major"), "member"), F.struct("c", "component")).alias("of")
        spread = by.groupBy("gram").agg(largest, F.count(F.lit(1)).alias("k")).filter("k > 1").select("gram", "of.major", "of.member")
        met = save(postings.select("gram", "rep", "pos").join(spread, "gram"), f"{where}/met-{turn}")
        rich = met.join(known.select("rep", "component", "n", "parts", "wide"), "rep")
        x, y = side(rich.filter("component <> major"), "x"), side(rich if turn == "all" else rich.filter("rep = member"), "y").drop("major")
        pairs = (
            x.join(y, "gram")
            .filter((F.col("component_x") != F.col("component_y")) & ((F.col("component_y") == F.col("major")) | (F.col("rep_x") < F.col("rep_y"))))
            .filter(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
            .filter(F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= needed)
            .filter(F.coalesce(common >= needed, F.lit(True)))
            .select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
            .distinct()
        )
        pairs = save(pairs.join(seen, ["a", "b"], "left_anti"), f"{where}/pairs-{turn}")
        remove(spark, *[f"{where}/{name}-{t}" for name, t in (("before", turn), ("known", turn), ("met", TURNS[k - 1])) if k or name != "met"])
        links = links.unionByName(save(verified(pairs, reps_refs, where + "/blocks", width, percent), f"{where}/links-{turn}"))
        seen = seen.unionByName(pairs)
    final = save(connected_components(links, where + "/second").select(F.col("node").alias("rep"), "component"), where + "/final")
    inside = save(final.join(of_class.select("rep", "least_id"), "rep"), where + "/inside")
    least_of = save(inside.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), where + "/least")
    placed = save(join_commonest(inside, least_of, "component", "members", "rep").select("rep", "component_id"), where + "/placed")
    of_turns = [f"{name}-{turn}" for name in ("met", "pairs", "links") for turn in TURNS]
    for name in ("classes", "leaders", "tried", "shared", "early", "refs", "inside", "least", *of_turns, "blocks"):
        remove(spark, f"{where}/{name}")
    out = members.join(placed, "rep", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "least_id", "doc_id").alias("component_id"),
        F.coalesce("least_id", "doc_id").alias("class_id"),
    )
