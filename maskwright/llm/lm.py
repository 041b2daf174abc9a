"""Language-model scores of whole documents: corpus counts for the base, a gated recurrent model for the score.

Documents are dealt to units of some megabytes by a hash of id and text, so a unit holds the same documents however the input lies,
and each unit's words are numbered once and kept in a file. A row for each distinct word of a unit goes to Spark, which adds up the corpus counts and joins
them back. The most frequent words become tokens of the recurrent model; a rarer word is the
token of its ending, times the word's share of that ending's smoothed counts, so every text has a probability.
A unit trains on its own training documents; sums of the units' weights are taken in a fixed order, so reruns agree.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, remove, rows_to_batch, save, shared_dir, tasks_for
from .gru import Model, dump, initial, load
from .jaccard import ngram_hashes

#: Words that are tokens of their own: at least so many, more with the root of the training tokens, and a bound on the model's size; and tokens for the endings of the others.
WORDS, WORDS_BY_ROOT, MOST_WORDS = 2_000, 0.15, 65_536
ENDINGS = 64
#: Tokens that training takes at least: a smaller corpus is gone over again, all documents alike, up to so many times.
LEAST_TRAINED, MOST_PASSES = 800_000, 16
#: Rounds of training; each takes its share of the training documents, then the units' models are averaged by tokens.
ROUNDS = 2
#: UTF-8 bytes of text for each unit, which sets their number; a unit that grows to four times that is closed and goes on as another.
UNIT_BYTES = 16 << 20
#: Models that one task adds up at a time.
FAN = 16

#: One row for each distinct word of a unit, and one with slot -1 for its file, where ``n`` is its training documents.
ROW_SQL = "block long, slot int, hash long, ending int, n long, file string"
ROW = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("hash", pa.int64()), ("ending", pa.int32()), ("n", pa.int64()), ("file", pa.string())])
WEIGHTS_SQL = "part long, block long, n long, params binary"
WEIGHTS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("params", pa.binary())])
OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def fold(doc_id: int | None) -> int:
    """Documents of fold 0 are held out; one without an id is."""
    return crc(doc_id) % 10


def _words(data: np.ndarray, ends: np.ndarray, n_docs: int):
    """(document, hash, ending) of every word, in order."""
    doc, h = ngram_hashes(data, ends, 1)
    if not len(h):
        return doc, h, np.zeros(0, np.uint8)
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    at = np.flatnonzero(~blank[data])
    last = np.ones(len(at), bool)
    last[:-1] = at[1:] != at[:-1] + 1
    edge = np.searchsorted(at, ends[(ends > 0) & (ends <= len(data))])
    last[edge[edge > 0] - 1] = True
    e = at[last]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    a, b = lower[data[e]].astype(np.int64), lower[data[np.maximum(e - 1, 0)]].astype(np.int64)
    return doc, h, ((a * 31 + b * 7) % ENDINGS).astype(np.uint8)


class Unit:
    """The words of a unit's documents: distinct hashes in ascending order, and each word's place among them."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.endings: list[np.ndarray] = []
        self.held: list[bytes] = []
        self.held_bytes = self.n_bytes = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.held.append(data)
        self.held_bytes += len(data)
        self.n_bytes += len(data)
        if self.held_bytes > 1 << 20:
            self._split()

    def _split(self) -> None:
        ends = np.cumsum([len(t) for t in self.held]).astype(np.int64)
        doc, h, end = _words(np.frombuffer(b"".join(self.held), np.uint8), ends, len(ends))
        self.sizes.append(np.bincount(doc, minlength=len(ends)))
        self.hashes.append(h)
        self.endings.append(end)
        self.held, self.held_bytes = [], 0

    def close(self, where: str, block: int) -> pa.RecordBatch:
        """Write the file, under a new name in every attempt, and give the unit's rows."""
        import zstandard

        if self.held:
            self._split()
        sizes, h, end = np.concatenate(self.sizes), np.concatenate(self.hashes), np.concatenate(self.endings)
        unique, first, slot = np.unique(h, return_index=True, return_inverse=True)
        train = np.array([fold(i) != 0 for i in self.ids], bool)
        counts = np.bincount(slot[np.repeat(train, sizes)], minlength=len(unique)).astype(np.int64)
        arrays = dump({
            "ids": np.array([0 if i is None else i for i in self.ids], np.int64), "known": np.array([i is not None for i in self.ids], bool),
            "sizes": sizes.astype(np.int64), "unique": unique, "endings": end[first], "slot": slot.astype(np.int32),
        })
        uri = f"{where}/{block:x}-{uuid.uuid4().hex}.words"
        fs, path = open_fs(uri)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(zstandard.ZstdCompressor(level=1).compress(arrays))
        m = len(unique) + 1
        columns = [
            np.full(m, block, np.int64), np.arange(-1, m - 1, dtype=np.int32), np.append(_I(0), unique.view(np.int64)),
            np.append(np.int32(0), end[first].astype(np.int32)), np.append(np.int64(train.sum()), counts),
        ]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([uri] + [None] * (m - 1), pa.string())], schema=ROW)


def read_unit(uri: str) -> dict:
    import zstandard

    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return load(zstandard.ZstdDecompressor().decompress(f.read()))


_I = np.int64


def _average(models: DataFrame, units: int) -> dict | None:
    """The mean of the units' weights by tokens: added ``FAN`` at a time, in order of the units, until few sums are left."""

    def add_up(table: pa.Table) -> pa.Table:
        out: dict = {}
        for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
            for k, v in load(row["params"]).items():
                out[k] = out[k] + v if k in out else v
        part = table.column("part")[0].as_py()
        return pa.table([pa.array([part]), pa.array([part]), pa.array([sum(table.column("n").to_pylist())]), pa.array([dump(out)], pa.binary())], schema=WEIGHTS)

    width = units
    while True:
        width = -(-width // FAN)
        models = models.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(add_up, WEIGHTS_SQL)
        if width <= FAN:
            break
    rows = sorted(models.collect(), key=lambda r: r["part"])
    n = sum(r["n"] for r in rows)
    if not n:
        return None
    sums = [load(r["params"]) for r in rows]
    return {k: (sum(s[k] for s in sums) / n).astype(np.float32) for k in sums[0]}


def words_for(n: int) -> int:
    """Words that are tokens, for so many training tokens."""
    return max(WORDS, min(MOST_WORDS, int(WORDS_BY_ROOT * n**0.5)))


def passes_for(n: int) -> int:
    return max(1, min(MOST_PASSES, -(-LEAST_TRAINED // max(n, 1))))


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int | None = None, rounds: int = ROUNDS, where: str | None = None, unit_bytes: int = UNIT_BYTES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id modulo 10 is 0 are held out; counts and model learn from all others.
    Tokens are the words, A-Z lower-cased, and one end. ``base_score`` is the smoothed unigram log10 probability, ``score``
    that of the recurrent model over the complete text, however long. Null text is empty: one end token. A null id counts as the id "",
    which is held out. Repeated rows count and are scored each; without training documents all counts are 0 and the model keeps its
    initial weights; an empty table gives no rows; other columns, whatever their names, are not read. Words are told apart by 64-bit hash.
    Neither counts nor model depend on the order of rows or on the number of tasks.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "lm")
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = body.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    units = max(1, -(-total // unit_bytes))
    n_tasks = tasks_for(spark, total)
    store = where + "/words"

    def number(batches):
        fs, folder = open_fs(store)
        fs.create_dir(folder, recursive=True)
        unit, block, last = Unit(), None, None
        for batch in batches:
            for u, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if u != last or unit.n_bytes >= 4 * unit_bytes:
                    if unit.ids:
                        yield unit.close(store, block)
                    unit, block, last = Unit(), (block + 1 if u == last else u << 24), u
                unit.add(doc_id, (data.as_py() or "").encode("utf-8"))
        if unit.ids:
            yield unit.close(store, block)

    dealt = body.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).alias("unit"), "doc_id", "text")
    dealt = dealt.repartition(n_tasks, "unit").sortWithinPartitions("unit", "doc_id", F.xxhash64("text"))
    rows = save(dealt.mapInArrow(number, ROW_SQL), where + "/rows")
    blocks = save(rows.filter("slot = -1").select("block", "file", "n"), where + "/units")
    of_words = rows.filter("slot >= 0")
    counts = save(of_words.groupBy("hash").agg(F.sum("n").alias("c"), F.min("ending").alias("ending")).filter("c > 0"), where + "/counts")

    train_docs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    end_n, end_v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        end_n[r["ending"]], end_v[r["ending"]] = r["n"], r["v"]
    N, V = int(end_n.sum()) + train_docs, int(end_v.sum()) + (train_docs > 0)
    words = words or words_for(N)
    top = counts.orderBy(F.desc("c"), "hash").limit(words).collect()
    top_h, top_c, top_e = (np.array([r[k] for r in top], np.int64) for k in ("hash", "c", "ending"))
    end_n = end_n - np.bincount(top_e, weights=top_c, minlength=ENDINGS).astype(np.int64)
    end_v = end_v - np.bincount(top_e, minlength=ENDINGS)
    # tokens by falling count: the end, the endings and the words
    raw = np.concatenate([[train_docs], end_n, top_c])
    place = np.argsort(-raw, kind="stable")
    token = np.empty(len(raw), np.int64)
    token[place] = np.arange(len(raw))
    end_token, ending_token, word_token = int(token[0]), token[1 : ENDINGS + 1], token[ENDINGS + 1 :]
    by_hash = np.argsort(top_h.view(np.uint64))
    params = initial(raw[place].astype(np.float64))
    tables = spark.sparkContext.broadcast((top_h.view(np.uint64)[by_hash], word_token[by_hash], ending_token, end_n, end_v))

    def token_ids(unit: dict):
        """(token of each distinct word, whether it is a word of its own)."""
        hashes, tokens, ending, _, _ = tables.value
        if not len(hashes):
            return ending[unit["endings"]], np.zeros(len(unit["unique"]), bool)
        k = np.minimum(np.searchsorted(hashes, unit["unique"]), len(hashes) - 1)
        own = hashes[k] == unit["unique"]
        return np.where(own, tokens[k], ending[unit["endings"]]), own

    def sequences(unit: dict, tokens: np.ndarray, chosen) -> list[np.ndarray]:
        ends = np.cumsum(unit["sizes"])
        return [np.append(tokens[unit["slot"][ends[k] - unit["sizes"][k] : ends[k]]], end_token).astype(np.int32) for k in chosen]

    for turn in range(rounds * passes_for(N)):
        start = spark.sparkContext.broadcast(dump(params))

        def train_on(batches, turn=turn, start=start):
            for batch in batches:
                for row in batch.to_pylist():
                    unit = read_unit(row["file"])
                    ids = [int(i) if known else None for i, known in zip(unit["ids"], unit["known"])]
                    chosen = [k for k, i in enumerate(ids) if fold(i) and crc(i) // 10 % rounds == turn % rounds]
                    if chosen:
                        mine = sequences(unit, token_ids(unit)[0], chosen)
                        model = Model(load(start.value))
                        model.run(mine, end_token, learn=True)
                        n = sum(map(len, mine))
                        yield rows_to_batch(WEIGHTS, [[row["block"] >> 24], [row["block"]], [n], [dump({k: v * np.float64(n) for k, v in model.p.items()})]])

        params = _average(blocks.select("block", "file").repartition(n_tasks, "block").mapInArrow(train_on, WEIGHTS_SQL), units) or params

    final = spark.sparkContext.broadcast(dump(params))

    def finish(unit: dict, c: np.ndarray, model: Model) -> pa.RecordBatch:
        sizes, slot, endings = unit["sizes"], unit["slot"], unit["endings"]
        tokens, own = token_ids(unit)
        _, _, _, rest_n, rest_v = tables.value
        share = np.where(own, 0.0, np.log10((c + 0.1) / (rest_n[endings] + 0.1 * (rest_v[endings] + 1))))
        base = np.log10((c + 0.1) / (N + 0.1 * (V + 1)))
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        per_doc = lambda w: np.bincount(doc, weights=w[slot], minlength=len(sizes))
        n_known = per_doc(c > 0).astype(np.int64) + int(train_docs > 0)
        base_score = per_doc(base) + np.log10((train_docs + 0.1) / (N + 0.1 * (V + 1)))
        found = model.run(sequences(unit, tokens, range(len(sizes))), end_token) / np.log(10) + per_doc(share)
        ids = [int(i) if known else None for i, known in zip(unit["ids"], unit["known"])]
        return rows_to_batch(OUT_SCHEMA, [ids, [fold(i) == 0 for i in ids], sizes + 1, n_known, [N] * len(ids), base_score, found])

    def score(batches):
        """Rows come by block and slot, the file's first: the counts of a unit's words are set in place."""
        model = Model(load(final.value))
        unit, c, last = None, None, None
        for batch in batches:
            block, slot, n = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                if block[a] != last:
                    if unit is not None:
                        yield finish(unit, c, model)
                    last, unit = block[a], read_unit(batch.column(3)[int(a)].as_py())
                    c = np.zeros(len(unit["unique"]), np.int64)
                    a += 1
                c[slot[a:b]] = n[a:b]
        if unit is not None:
            yield finish(unit, c, model)

    met = of_words.select("hash", "block", "slot").join(counts.select("hash", "c"), "hash").select("block", "slot", "c", F.lit(None).cast("string").alias("file"))
    told = met.unionByName(blocks.select("block", F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("c"), "file"))
    scores = told.repartition(n_tasks, "block").sortWithinPartitions("block", "slot").mapInArrow(score, OUT_SQL)
    scores = save(scores, where + "/scores")
    remove(spark, *[f"{where}/{name}" for name in ("rows", "counts", "units", "words")])
    return scores
