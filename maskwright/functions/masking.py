"""Whole-term, longest-first, non-overlapping replacement: with each row's own pairs and with fixed terms, in Spark's own functions; plain for file parts."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, greedy_spans, let, parts_of, quoted, running_sum, splice, term_pattern_column

PAIRS = "array<struct<original:string,placeholder:string>>"


@lru_cache(100_000)
def _pattern(term: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_]){re.escape(term)}(?![^\W_])", re.IGNORECASE)


def longest_first(pairs: list[tuple[str, str]], by: int = 0) -> list[tuple[str, str]]:
    """Stable order by falling length of the original (0) or placeholder (1)."""
    return sorted(pairs, key=lambda p: -len(p[by]))


def ranges(text: str, pairs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, placeholder) of all matches in pair order that no earlier range overlaps, by start.

    Taken places are kept as a sorted list, so a text costs its matches and not their square.
    """
    from bisect import bisect_left, insort

    taken: list[tuple[int, int, str]] = []
    low = text.lower()
    for original, mark in pairs:
        # lower case alone proves absence only where it folds as the pattern does
        if original.isascii() and low.isascii() and original.lower() not in low:
            continue
        for m in _pattern(original).finditer(text):
            a, b = m.span()
            k = bisect_left(taken, (a, b, ""))
            if (k < len(taken) and taken[k][0] < b) or (k and taken[k - 1][1] > a):
                continue
            insort(taken, (a, b, mark))
    return taken


def mask(text: str, pairs: list[tuple[str, str]]) -> str:
    out, at = [], 0
    for a, b, mark in ranges(text, pairs):
        out += (text[at:a], mark)
        at = b
    return "".join(out) + text[at:]


def pair_spans(text: Column, pairs: Column) -> Column:
    """Spans (start, end, mark) that replacement takes: all matches of all pairs, chosen in pair order, none over another.

    A pair whose folded letters the folded text hasn't got is passed over without its pattern.
    """
    have = lambda low: F.filter(
        F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["original"].alias("original"), p["placeholder"].alias("mark"))),
        lambda x: (x["original"] != "") & (F.contains(low, F.lower(F.upper(x["original"]))) | x["original"].rlike(r"[^\x00-\x7F]")),
    )
    # what a pattern leaves between its matches gives their places, as a match is as long as its term
    each = lambda x, gaps: F.transform(F.slice(running_sum(F.transform(gaps, F.length)), F.lit(2), F.size(gaps) - 1), lambda at, k: let(
        at + k * F.length(x["original"]), lambda s: F.struct(s.alias("start"), (s + F.length(x["original"])).alias("end"), x["mark"].alias("mark"), x["i"].alias("i"))))
    found = lambda kept: F.flatten(F.transform(kept, lambda x: let(F.split(text, term_pattern_column(x["original"]), -1), lambda gaps: each(x, gaps))))
    order = lambda a, b: F.when(a["i"] != b["i"], a["i"] - b["i"]).otherwise(a["start"] - b["start"]).cast("int")
    return greedy_spans(let(let(F.lower(F.upper(text)), have), found), order)


def mask_exact(text: Column, pairs: Column) -> Column:
    """Text of each row with its own pairs, in their order, in Spark's own functions; null text stays null, null pairs change nothing."""
    return F.when(F.size(F.coalesce(pairs, F.array().cast(PAIRS))) > 0, splice(text, pair_spans(text, pairs))).otherwise(text)


def unmask_pairs(mapping) -> list[tuple[str, str]]:
    """(placeholder, first original) of mapping entries, longest placeholder first."""
    first: dict[str, str] = {}
    for e in mapping if mapping is not None else []:
        if e["placeholder"]:
            first.setdefault(e["placeholder"], e["original"])
    return longest_first(list(first.items()))


#: A private-use character leads every code of the native form: with the next one it stands for itself, with those after for a term.
LEAD, SELF, FIRST = "\ue000", "\ue001", 0xE002
CODES = 0xF8FF - FIRST


def native_fits(pairs: list[tuple[str, str]]) -> bool:
    """Whether ``mask_native`` equals the exact form: terms with a letter or digit at both ends, and nothing that looks like a code."""
    several = sum(not p[0].isalnum() for p in pairs)
    plain = all(p[0] and p[0][0].isalnum() and p[0][-1].isalnum() and LEAD not in p[0] + p[1] for p in pairs)
    return plain and several <= CODES


def folded(text: Column) -> Column:
    """Case folded sign by sign, as a case-insensitive pattern compares."""
    both = F.lower(F.upper(text))
    return F.when(F.length(both) == F.length(text), both).otherwise(F.lower(text))


def _folded(text: str) -> str:
    both = text.upper().lower()
    return both if len(both) == len(text) else text.lower()


def mask_native(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The same replacement for fixed pairs in Spark's own functions, without Python.

    Terms of several words, longest first, turn into codes of two private characters, which no later term can match or join; a text's own
    lead character is coded too. A term of one word can only lie inside those, so all of them are looked up word by word in one pass.
    """
    ordered = longest_first(pairs)
    several = [p for p in ordered if not p[0].isalnum()]
    single: dict[str, str] = {}
    for original, mark in ordered:
        if original.isalnum():
            single.setdefault(_folded(original), mark)
    out = F.replace(text, F.lit(LEAD), F.lit(LEAD + SELF)) if several else text
    for k, (original, _) in enumerate(several):
        out = F.regexp_replace(out, F.lit(f"(?iu)(?<![{ALNUM}]){quoted(original)}(?![{ALNUM}])"), F.lit(LEAD + chr(FIRST + k)))
    if single:
        marks = F.create_map(*[F.lit(x) for pair in single.items() for x in pair])
        word = lambda w: F.when(folded(w).isin(*single), F.element_at(marks, folded(w))).otherwise(w)
        out = F.array_join(F.transform(F.regexp_extract_all(out, F.lit(f"[{ALNUM}]+|[^{ALNUM}]+"), F.lit(0)), word), "")
    for k, (_, mark) in enumerate(several):
        out = F.replace(out, F.lit(LEAD + chr(FIRST + k)), F.lit(mark))
    return F.replace(out, F.lit(LEAD + SELF), F.lit(LEAD)) if several else out


def mask_fixed(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Native where that is exact, otherwise the exact form."""
    if native_fits(pairs):
        return mask_native(text, pairs)
    literal = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("placeholder")) for a, b in longest_first(pairs)])
    return mask_exact(text, literal)


def segments(runs: list[str], found: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(text, run whose format it takes) after replacement: a placeholder takes that of the run its match starts in.

    Other text parts where runs do; empty runs vanish.
    """
    starts, n = [], 0
    for r in runs:
        starts.append(n)
        n += len(r)
    full = "".join(runs)
    from bisect import bisect_right

    owner = lambda pos: max(k for k in range(bisect_right(starts, pos)) if runs[k] or k == 0)
    out: list[tuple[str, int]] = []

    def plain(a: int, b: int) -> None:
        while a < b:
            k = owner(a)
            stop = min(b, starts[k] + len(runs[k]))
            out.append((full[a:stop], k))
            a = stop

    at = 0
    for a, b, mark in found:
        plain(at, a)
        out.append((mark, owner(a)))
        at = b
    plain(at, n)
    return out


def with_segments(df: DataFrame, runs: str, spans: str, out: str = "segments") -> DataFrame:
    """The rows with ``out``, array<struct<text,run>>: what ``segments`` gives for array<string> ``runs`` and the chosen ``spans`` (start, end, mark) of their joined text.

    One Arrow function over columns, with no loop over rows or runs. Null runs or spans count as none.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(SEGMENTS))])

    def work(batches):
        for batch in (part for whole in batches for part in parts_of(whole)):
            yield pa.RecordBatch.from_arrays([*batch.columns, cut_up(batch.column(runs), batch.column(spans))], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


SEGMENTS = "array<struct<text:string,run:int>>"


def cut_up(runs: pa.ListArray, spans: pa.ListArray) -> pa.ListArray:
    """``segments`` of each row of a batch.

    The texts of all rows lie end to end. Starts of runs and spans are merged into one sorted list; the run in force and the place reached at each are running maxima, which need no
    reset, as both only grow from row to row. Every event then gives its mark, if it is a span's, and the text from the place reached to the next event. Empty runs are no events.
    """
    counts, n_spans = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (runs, spans))
    each, rows = pc.fill_null(runs.flatten(), ""), np.arange(len(runs))
    size = pc.utf8_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    row_of_run, row_of_span = np.repeat(rows, counts), np.repeat(rows, n_spans)
    length = np.bincount(row_of_run, weights=size, minlength=len(rows)).astype(np.int64)
    base, first_run = np.cumsum(length) - length, np.cumsum(counts) - counts
    found = spans.flatten()
    begin, end = (base[row_of_span] + found.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    full = np.flatnonzero(size > 0)
    # at one place a run begins before the span does
    row = np.concatenate([row_of_run[full], row_of_span])
    at = np.concatenate([(np.cumsum(size) - size)[full], begin])
    order = np.lexsort((np.arange(len(row)) >= len(full), at, row))
    row, at = row[order], at[order]
    run = np.maximum.accumulate(np.concatenate([full, np.full(len(begin), -1)])[order])
    start = np.maximum.accumulate(np.concatenate([(np.cumsum(size) - size)[full], end])[order])
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    stop = np.maximum(start, np.where(last, (base + length)[row], np.append(at[1:], 0)[: len(row)]))
    # texts are the even ones of the strings between all places
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each), "")[0].as_buffer()
    raw = np.frombuffer(joined, np.uint8)
    byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    places = byte_at[np.column_stack([start, stop]).reshape(-1)].astype(np.int32)
    strings = pa.StringArray.from_buffers(max(0, len(places) - 1), pa.py_buffer(places if len(places) else np.zeros(1, np.int32)), joined)
    marks = found.field("mark")
    pieces = pa.concat_arrays([strings, marks.cast(pa.string())])
    # a mark, then the text after it
    is_mark = order >= len(full)
    which = np.column_stack([len(strings) + np.where(is_mark, order - len(full), 0), 2 * np.arange(len(row))])
    given = np.zeros(len(row), bool)
    given[is_mark] = marks.is_valid().to_numpy(zero_copy_only=False)[(order - len(full))[is_mark]]
    keep = np.column_stack([given, start < stop]).reshape(-1)
    of_row = np.repeat(row, 2)[keep]
    local = np.repeat(np.maximum(run - first_run[row], 0), 2)[keep]
    fields = [pa.field("text", pa.string()), pa.field("run", pa.int32())]
    values = pa.StructArray.from_arrays([pieces.take(pa.array(which.reshape(-1)[keep])), pa.array(local, pa.int32())], fields=fields)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(rows)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
