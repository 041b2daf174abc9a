"""Terms against texts in one pass: presence, highlights, first mentions and previews, with the text never leaving its row."""

from __future__ import annotations

import uuid
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LABELS, PART, parts_of  # noqa: F401

#: Letters of terms in one automaton; a longer dictionary is met in several, one pass over the rows after another, none with more.
MOST_LETTERS = 32 << 20
#: Own patterns of a row up to which they are looked up one by one.
FEW = 8

HIT = "struct<block:int,start:int,end:int,entity:string,term:string,category:string,score:int,src:int,from:int,ord:long>"
_HIT = pa.struct([("block", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("term", pa.string()), ("category", pa.string()), ("score", pa.int32()), ("src", pa.int32()), ("from", pa.int32()), ("ord", pa.int64())])


class _Folds(dict):
    """Case folded sign by sign, so that places stay: upper case first, then lower, where either is one sign."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        upper = sign.upper() if len(sign.upper()) == 1 else sign
        lower = upper.lower() if len(upper.lower()) == 1 else upper
        self[code] = "i" if code == 0x130 else lower
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _joins(sign: str, underscore: bool) -> bool:
    return sign.isalnum() or (underscore and sign == "_")


class Finder:
    """All whole-term matches of a dictionary in a text, by one walk over an automaton of the folded terms."""

    def __init__(self, terms: list[tuple[str, str | None, int]], underscore_joins: bool = True):
        import ahocorasick

        self.terms, self.underscore = terms, underscore_joins
        spelled: dict[str, list[int]] = {}
        for k, (term, _, _) in enumerate(terms):
            spelled.setdefault(folded(term), []).append(k)
        spelled.pop("", None)
        self.automaton = ahocorasick.Automaton()
        for word, numbers in spelled.items():
            self.automaton.add_word(word, (len(word), numbers))
        if spelled:
            self.automaton.make_automaton()
        self.empty = not spelled

    def __call__(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term), by end; matches of one term don't overlap, the first is taken."""
        if self.empty or not text:
            return
        last: dict[int, int] = {}
        n = len(text)
        for at, (size, numbers) in self.automaton.iter(folded(text)):
            start, end = at + 1 - size, at + 1
            if (start and _joins(text[start - 1], self.underscore)) or (end < n and _joins(text[end], self.underscore)):
                continue
            for k in numbers:
                if last.get(k, 0) <= start:
                    last[k] = end
                    yield start, end, k


def places_of(patterns: list[str]) -> Callable[[str], Iterator[tuple[int, int]]]:
    """A function that gives (first place, number) of the patterns that a text has, as plain substrings; many are met in one walk, by an automaton that is built once for all texts."""
    if len(patterns) <= FEW:
        return lambda text: ((at, k) for k, p in enumerate(patterns) if p and (at := text.find(p)) >= 0)
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        if p:
            automaton.add_word(p, (len(p), (*automaton.get(p, (0, ()))[1], k)))
    automaton.make_automaton()

    def places(text: str) -> Iterator[tuple[int, int]]:
        seen: set[int] = set()
        for at, (size, numbers) in automaton.iter(text) if len(automaton) else ():
            if numbers[0] not in seen:
                seen.update(numbers)
                yield from ((at + 1 - size, k) for k in numbers)

    return places


def first_places(text: str, patterns: list[str]) -> Iterator[tuple[int, int]]:
    """``places_of`` in one text."""
    return places_of(patterns)(text)


_BUILT: dict[str, Finder] = {}


def _with_column(batch: pa.RecordBatch, rows: list[list[tuple]]) -> pa.RecordBatch:
    flat = list(zip(*(hit for row in rows for hit in row))) or [()] * len(_HIT)
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _HIT)], fields=list(_HIT))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[*batch.schema.names, "_hits"])


def _each(df: DataFrame, texts: str, hits_of: Callable[[pa.RecordBatch], Iterator[list[tuple]]]) -> DataFrame:
    """The rows with ``_hits``, array of ``HIT``: what ``hits_of`` gives for each row of a batch."""
    schema = T.StructType([*df.schema.fields, T.StructField("_hits", T._parse_datatype_string(f"array<{HIT}>"))])

    def work(batches):
        for batch in batches:
            for part in parts_of(batch):
                yield _with_column(part, list(hits_of(part)))

    return df.mapInArrow(work, schema)


def _blocks(value) -> list[str]:
    v = value.as_py()
    return [] if v is None else [v] if isinstance(v, str) else [x or "" for x in v]


def dictionary(terms: DataFrame, underscore_joins: bool = True) -> list[Callable[[], tuple[Finder, list[tuple]]]]:
    """The terms (term, category[, seq]) in parts of at most ``MOST_LETTERS`` letters: functions that give a task its automaton, built once a worker, and its entries."""
    body = terms.select("term", "category", (F.col("seq") if "seq" in terms.columns else F.monotonically_increasing_id()).cast("long").alias("seq")).filter("term <> ''")
    letters = body.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    parts = max(1, -(-letters // MOST_LETTERS))

    def part_of(rows: list) -> Callable[[], tuple[Finder, list[tuple]]]:
        spread = terms.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r["term"], r["category"], r["seq"]) for r in rows), key=lambda r: r[2])))

        def built():
            token, entries = spread.value
            if token not in _BUILT:
                _BUILT.clear()
                _BUILT[token] = Finder(entries, underscore_joins)
            return _BUILT[token], entries

        return built

    return [part_of((body.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part) if parts > 1 else body).collect()) for part in range(parts)]


def _hits_in(texts: list[str], finder: Finder, entries: list[tuple]) -> list[tuple]:
    return [(b, a, z, t[a:z], entries[k][0], entries[k][1], 100, 0, a, entries[k][2]) for b, t in enumerate(texts) for a, z, k in finder(t)]


def _passes(df: DataFrame, parts: list, text: str) -> DataFrame:
    for n, built in enumerate(parts):

        def hits_of(batch, built=built):
            finder, entries = built()
            for value in batch.column(text):
                yield _hits_in(_blocks(value), finder, entries)

        if n:
            df = _each(df.withColumnRenamed("_hits", "_before"), text, hits_of).withColumn("_hits", F.concat("_before", "_hits")).drop("_before")
        else:
            df = _each(df, text, hits_of)
    return df


def with_hits(df: DataFrame, terms: DataFrame, text: str = "text", underscore_joins: bool = True) -> DataFrame:
    """The rows with ``_hits``: every match of every term (term, category[, seq]) in ``text``, a string or an array of blocks.

    The dictionary goes to every task as one automaton of at most ``MOST_LETTERS`` letters; a longer one in parts, each a further pass over the same rows. Rows stay what they are
    and where they are: repeated rows, null texts and null ids all keep their own hits. ``ord`` is the term's place in the dictionary.
    """
    return _passes(df, dictionary(terms, underscore_joins), text)


def present_terms(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, category) of the terms that occur in a document, as whole words with underscores joining; once for each row and term."""
    found = with_hits(docs.select("doc_id", F.col(text).alias("_text")), terms, "_text")
    met = F.array_distinct(F.transform("_hits", lambda h: F.struct(h["term"].alias("term"), h["category"].alias("category"), h["ord"].alias("ord"))))
    return found.select("doc_id", F.explode(met).alias("t")).select("doc_id", "t.term", "t.category")


def term_highlights(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """All matches of every term in blocks (doc_id, block_seq, text): one row each, with places and source term."""
    found = with_hits(blocks.select("doc_id", "block_seq", F.col("text").alias("_text")), terms, "_text")
    h = found.select("doc_id", "block_seq", F.explode("_hits").alias("h"))
    return h.select("doc_id", "block_seq", "h.start", "h.end", "h.entity", F.col("h.term").alias("source_entity"), "h.category", "h.score")


def chosen(hits: list[tuple]) -> list[tuple]:
    """Hits in reading order; of those of a block that overlap the longer, then the surer, then that of the earlier source and term stays."""
    hits = sorted(hits, key=itemgetter(0, 1))
    out, at, n = [], 0, len(hits)
    while at < n:
        upto, reach = at + 1, hits[at][2]
        while upto < n and hits[upto][0] == hits[at][0] and hits[upto][1] < reach:
            reach = max(reach, hits[upto][2])
            upto += 1
        if upto == at + 1:
            out.append(hits[at])
        else:
            first = lambda h: (h[1] - h[2], -1 if h[6] is None else -h[6], h[7], h[8], h[4] is not None, h[4] or "", h[5] is not None, h[5] or "")
            starts, kept = [], []
            for h in sorted(hits[at:upto], key=first):
                k = bisect(starts, h[1])
                if (not k or kept[k - 1][2] <= h[1]) and (k == len(kept) or kept[k][1] >= h[2]):
                    starts.insert(k, h[1])
                    kept.insert(k, h)
            out += kept
        at = upto
    return out


class _Lowers(dict):
    """Lower case sign by sign, as in SQL: İ is i."""

    def __missing__(self, code: int) -> str:
        self[code] = "i" if code == 0x130 else chr(code).lower()
        return self[code]


_LOWERS = _Lowers()


def numbered(hits: list[tuple]) -> list[str]:
    """Placeholders of hits in reading order: one for each spelling, numbered by the label of its first hit's category."""
    names: dict[str, str] = {}
    counts: Counter = Counter()
    out = []
    for h in hits:
        key = h[3].lower() if h[3].isascii() else h[3].translate(_LOWERS)
        if key not in names:
            label = LABELS.get(h[5], "SENSIBLE")
            counts[label] += 1
            names[key] = f"[{label}_{counts[label]}]"
        out.append(names[key])
    return out


HIGHLIGHT = "struct<start:int,end:int,entity:string,source_entity:string,placeholder:string,status:string,score:int,category:string>"
_HIGHLIGHT = [pa.field(n, t) for n, t in (("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("source_entity", pa.string()), ("placeholder", pa.string()), ("status", pa.string()), ("score", pa.int32()), ("category", pa.string()))]


def preview_rows(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, block_seq, section, text, highlights), one row per block that has a highlight, of (doc_id, blocks array<struct<block_seq,section,text>>, finds array<struct<src,entity,category,score>>).

    A document is a row until its highlights are known: its blocks meet the dictionary's automaton, then its own finds, as plain substrings with their case, at the first place in
    each block; of overlapping highlights of a block the longer, then the surer, then that of the earlier source stays; placeholders are numbered by label in reading order, one
    for each spelling. No shuffle, and no expression over the hits of a row.
    """
    rows, parts = docs.select("doc_id", "blocks", "finds"), dictionary(terms)
    built = parts[0]
    if several := len(parts) > 1:
        rows = _passes(rows.withColumn("_texts", F.transform("blocks", lambda b: b["text"])), parts, "_texts").drop("_texts")
    block = docs.schema["blocks"].dataType.elementType
    schema = T.StructType([docs.schema["doc_id"], *(block[c] for c in ("block_seq", "section", "text")), T.StructField("highlights", T._parse_datatype_string(f"array<{HIGHLIGHT}>"))])

    def highlighted(part: pa.RecordBatch) -> pa.RecordBatch:
        finder, entries = (None, None) if several else built()
        sizes = pc.fill_null(pc.list_value_length(part.column("blocks")), 0).to_pylist()
        blocks = part.column("blocks").flatten()
        texts = [t or "" for t in blocks.field("text").to_pylist()]
        flat, marks, doc, which, ends, at = [], [], [], [], [0], 0
        for row, (size, finds) in enumerate(zip(sizes, part.column("finds").to_pylist())):
            mine = texts[at : at + size]
            hits = [tuple(h.values()) for h in part.column("_hits")[row].as_py()] if several else _hits_in(mine, finder, entries)
            if finds:
                places = places_of([f["entity"] or "" for f in finds])
                hits += [(b, a, a + len(f["entity"]), f["entity"], "", f["category"], f["score"], f["src"], a, k) for b, t in enumerate(mine) for a, k in places(t) for f in (finds[k],)]
            hits = chosen(hits)
            marks += numbered(hits)
            last = None
            for n, h in enumerate(hits, len(flat)):
                if h[0] != last:
                    last = h[0]
                    doc.append(row)
                    which.append(at + last)
                    ends.append(n)
            flat += hits
            at += size
        _, start, end, entity, term, category, score, _, _, _ = zip(*flat) if flat else [()] * len(_HIT)
        columns = (start, end, entity, term, marks, ["confirmed"] * len(flat), score, category)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIGHLIGHT)], fields=_HIGHLIGHT)
        met = blocks.take(pa.array(which, pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array([*ends[1:], len(flat)] if flat else [0], pa.int32()), values)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc, pa.int64())), *(met.field(c) for c in ("block_seq", "section", "text")), lists], names=schema.names)

    def work(batches):
        for batch in batches:
            for part in parts_of(batch):
                yield highlighted(part)

    return rows.mapInArrow(work, schema)


def with_known_category(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Add ``category`` to (entity, ...): that of the first of (category, term, seq) equal but for case, or autres.

    An equi join on the lower-cased spelling; the dictionary has one row for each.
    """
    first = terms.groupBy(F.lower("term").alias("_spelling")).agg(F.min_by("category", "seq").alias("category"))
    return found.withColumn("_spelling", F.lower("entity")).join(first, "_spelling", "left").withColumn("category", F.coalesce("category", F.lit("autres"))).drop("_spelling")
