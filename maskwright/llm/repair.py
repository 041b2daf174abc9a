"""Repair of conversations by weighted finite-state composition: input acceptor, edit transducer and role grammar."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, rows_to_batch, save, shared_dir

BLANK = r"\x20\x09-\x0D"
#: The role grammar (s?(ua)+)?: state, initial, next state; and the states where a conversation may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = range(len(GRAMMAR))
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a piece: its best paths are strings as long, for each pair of grammar states.
PIECE = 1_024

#: A weight is (cost, labels): the lesser of two is the better, and weights of consecutive paths add up.
Weight = tuple[int, str]


def insertions(state: int) -> Iterator[tuple[Weight, int]]:
    """Ways to insert turns at one place, from a grammar state: never back to a state met, as that only costs."""
    met, found = {state}, [((0, ""), state)]
    while found:
        (cost, labels), at = found.pop(0)
        yield (cost, labels), at
        for initial, then in GRAMMAR[at].items():
            if initial in NAMES and then not in met:
                met.add(then)
                found.append(((cost + INSERT, labels + "I"), then))


def edits(initial: str, must_go: bool, truncated: bool) -> Iterator[tuple[Weight, str]]:
    """The edit transducer for one row: what it may become, "" for nothing."""
    yield (DELETE, "D"), ""
    if not must_go:
        more = TRUNCATED * truncated
        yield (more, "K"), initial
        for other in NAMES:
            yield (REROLE + more, "R"), other


@lru_cache
def step(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, labels) over one row: insertions, then an edit, through the grammar; composed when a kind of row is first met.

    Insertions come before a row, so every label string of the same rows has as many other letters and ends in one: none
    begins another, and the best of two stays the best whatever follows.
    """
    best: dict[tuple[int, int], Weight] = {}
    for state in STATES:
        for (c1, l1), between in insertions(state):
            for (c2, l2), out in edits(initial, must_go, truncated):
                then = between if not out else GRAMMAR[between].get(out)
                if then is not None:
                    w = (c1 + c2, l1 + l2)
                    best[state, then] = min(w, best.get((state, then), w))
    return tuple((g, h, c, labels) for (g, h), (c, labels) in best.items())


def advance(row: list[Weight | None], arcs: Iterable[tuple[int, int, int, str]]) -> list[Weight | None]:
    """Best weights of the states after the arcs, from those before."""
    out: list[Weight | None] = [None] * len(STATES)
    for g, h, cost, labels in arcs:
        if row[g] is not None:
            w = (row[g][0] + cost, row[g][1] + labels)
            if out[h] is None or w < out[h]:
                out[h] = w
    return out


def finish(row: list[Weight | None]) -> Weight:
    """The best path to the end: last insertions lead to a final state."""
    ends = [(w[0] + c, w[1] + labels) for g, w in enumerate(row) if w is not None for (c, labels), h in insertions(g) if h in FINAL]
    return min(ends)


class Piece:
    """Consecutive rows of a conversation: counts, ends, and best paths between grammar states."""

    def __init__(self, starts: Iterable[int]):
        self.paths = {g: [(0, "") if h == g else None for h in STATES] for g in starts}
        self.counts = [0, 0, 0, 0]
        self.first = self.last = None
        self.turns, self.low, self.high, self.n = 0, None, None, 0

    def add(self, turn: int | None, initial: str, blank: bool, seen: bool, truncated: bool) -> None:
        truncated = truncated and not blank and not seen
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.counts[0] += blank
        self.counts[1] += seen and not blank
        self.counts[2] += truncated
        self.counts[3] += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last, self.n = self.first or initial, initial, self.n + 1
        arcs = step(initial if initial in "sua" else "?", blank or seen, truncated)
        self.paths = {g: advance(row, arcs) for g, row in self.paths.items()}

    def told(self) -> str:
        arcs = [(g, h, *w) for g, row in self.paths.items() for h, w in enumerate(row) if w is not None]
        return json.dumps([arcs, self.counts, self.first, self.last, self.turns, self.low, self.high])


class Whole:
    """A conversation put together from its pieces in order."""

    def __init__(self):
        self.row: list[Weight | None] = [(0, ""), None, None, None]
        self.counts, self.last = [0, 0, 0, 0], None
        self.turns, self.low, self.high = 0, None, None

    def add(self, told: str) -> None:
        arcs, counts, first, last, turns, low, high = json.loads(told)
        self.row = advance(self.row, arcs)
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += self.last is not None and self.last + first not in LEGAL
        self.last = last
        if turns:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


class Repaired:
    """Follows the labels of a path over the rows and gives the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        # an odd number of turns begins with a system turn, so the others alternate from the second
        return NAMES["ua"[(self.out - self.odd) % 2]]

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._role() + ":"
            self.at, self.out = self.at + 1, self.out + 1

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield (role if edit == "K" else self._role()) + ":" + text
            self.out += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by crc32 of ``conv_id:turn`` modulo 20, with ``dropped`` rows marked: a null is one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("_fault", fault)
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    out = rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), (F.col("_fault") == 0).alias("dropped"), times)
    return out.drop("col")


PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("body", pa.string())])
OUT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OUT = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (part.split()[0] for part in OUT_SQL.split(", "))])


def pieces(rows: DataFrame, where: str) -> DataFrame:
    """(conv_id, part, seq, body) of the kept rows of (conv_id, turn, role, text): what every run of a conversation's rows comes to.

    Rows are dealt by range of (conv_id, turn, role, digest), so a conversation with very many rows spreads over many tasks; texts stay behind. That
    a role and text were met before is found by the least turn of each, with partial sums.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    units = slim.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    units = save(units, where + "/units")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = units.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    told = units.join(first, same).select("conv_id", "turn", "role", "digest", "copies", "blank", "cut", (place != F.col("_first")).alias("seen"))
    told = save(told, where + "/told")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = told.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def work(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        piece, conv = None, None
        for batch in batches:
            out = []

            def close():
                nonlocal piece, seq
                out.append((conv, part, seq, piece.told()))
                piece, seq = None, seq + 1

            for c, turn, role, _, copies, blank, cut, seen in zip(*(col.to_pylist() for col in batch.columns)):
                if piece is not None and c != conv:
                    close()
                    piece = Piece((0,))
                conv = c
                for _ in range(copies):
                    if piece is not None and piece.n >= PIECE:
                        close()
                    if piece is None:  # what is before it may be in another piece
                        piece = Piece(STATES)
                    piece.add(turn, role[:1] or " ", blank, seen, cut)
                    seen = True
            if out:
                yield rows_to_batch(PIECES, list(zip(*out)))
        if piece is not None:
            yield rows_to_batch(PIECES, [[conv], [part], [seq], [piece.told()]])

    return dealt.mapInArrow(work, "conv_id long, part int, seq int, body string")


def repair_conversations(rows: DataFrame, where: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` is (conv_id, turn, role, text[, dropped]); dropped rows only say that their conversation is there. A conversation is the
    input acceptor; its rows in order of turn (nulls first; equal turns by role and SHA-256 of the text) meet the edit transducer and the role grammar, composed when a
    kind of row is first met. Every row is after all before it, so the shortest path is found in one pass in topological order, over weights (cost, labels) of which
    the lesser is better. Pieces of conversations are found in parallel, as best paths between all pairs of grammar states, and put together in order; then
    each conversation's texts pass its path once, in order, and are hashed as they pass: one conversation takes the memory of its path and never of its texts.

    A null conv_id is a conversation like others; null roles and texts are one space, and an empty role is one too. A role that begins with neither s, u nor a
    is never kept. Repeated rows count as often as they come; texts are whole, however long. Without rows (all dropped): zeros, an empty audit and the hash of an empty string. An
    empty table gives no rows; other columns are not read. SHA-256 takes a conversation's text in order, so one conversation's hashing is one task.
    """
    spark = rows.sparkSession
    where = where or shared_dir(spark, "repair")
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    body = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), "dropped")
    there = body.filter("not dropped")
    none = lambda t: F.lit(None).cast(t)
    texts = there.select("conv_id", F.lit(2).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("seq"), "turn", "role", F.sha2("text", 256).alias("digest"), F.col("text").alias("body"))
    marks = body.filter("dropped").select("conv_id", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("seq"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("body"))
    paths = save(pieces(there, where), where + "/pieces").select("conv_id", F.lit(1).alias("kind"), "part", "seq", none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), "body")
    order = ["conv_id", "kind", "part", "seq", "turn", "role", "digest"]
    stream = texts.unionByName(marks).unionByName(paths).repartition(partitions(spark), "conv_id").sortWithinPartitions(*order)

    def work(batches):
        whole, conv, follow, digest, cost, audit, lines = None, None, None, None, 0, "", 0

        def emit(lines_of):
            nonlocal lines
            for line in lines_of:
                digest.update((("\n" if lines else "") + line).encode("utf-8"))
                lines += 1

        def begin_texts():
            nonlocal follow, cost, audit
            cost, audit = finish(whole.row)
            follow = Repaired(audit)

        def close():
            if follow is None:
                begin_texts()
            emit(follow.inserted())
            return (conv, whole.gaps(), *whole.counts, cost, audit, digest.hexdigest())

        for batch in batches:
            out = []
            for c, kind, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 5)), batch.column(7)):
                if whole is None or c != conv:
                    if whole is not None:
                        out.append(close())
                    whole, conv, follow, digest, lines = Whole(), c, None, hashlib.sha256(), 0
                if kind == 1:
                    whole.add(text.as_py())
                elif kind == 2:
                    if follow is None:
                        begin_texts()
                    emit(follow.row(role, text.as_py()))
            if out:
                yield rows_to_batch(OUT, list(zip(*out)))
        if whole is not None:
            yield rows_to_batch(OUT, [[v] for v in close()])

    return stream.mapInArrow(work, OUT_SQL)
