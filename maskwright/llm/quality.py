"""Quality rules: one Spark projection compiled from a threshold table, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

from .common import WORD

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that for it on with as was be by at from "
    "le la les de des du et en un une que qui dans pour par sur est au "
    "el los las del y se con una su al lo como "
    "der die das und ist von den mit zu ein eine auf nicht für im dem sich"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``least <= numerator / denominator <= most``; rules of a ratio start at ``from_words`` words."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None
    from_words: int = 0


#: The production thresholds, over the columns that ``measures`` makes.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("exclamations", "n_exclaimed", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, so that a lambda never computes it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, width: int) -> Column:
    """Hash of each word window, by position."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array.

    Window hashes that all differ settle a text; otherwise windows are sorted by hash within the
    row and equal neighbours are compared word by word.
    """

    def counted(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, covered))

    def covered(s: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, width) == F.slice(words, y["i"] + 1, width))
        twice = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))),
                F.lit(0),
                lambda acc, x: acc + x,
            ),
        )

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(_windows(words, width), counted)).cast("long")


def measures(text: Column) -> Column:
    """The counts that the rules divide, as one struct computed once for each text; null text counts as empty.

    Fields: n_words, word_chars, n_symbols, n_exclaimed, n_lines (lines with a word), n_dup_lines, n_ellipsis_lines,
    n_bullet_lines, n_stop_words, n_repeat_words (long). One nested expression, so that a filter on a field that is
    pushed below its projection holds it once and not once for each mention.
    """
    body = F.coalesce(text, F.lit(""))

    def counts(x: Column) -> Column:
        whole, words, lines = x["text"], x["words"], x["lines"]
        fields = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")),
            "n_exclaimed": F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit(""))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda v: F.rtrim(v).endswith("...") | F.rtrim(v).endswith("…"))),
            "n_bullet_lines": F.size(F.filter(lines, lambda v: F.ltrim(v).rlike("^[-*•]"))),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in fields.items()])

    parts = F.struct(
        body.alias("text"),
        F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda v: v.rlike(WORD)).alias("lines"),
    )
    return _let(parts, counts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def compile_rules(m: Column, rules=RULES) -> Column:
    """The threshold table as one boolean expression over measures; a rule without a denominator value passes."""
    verdict = F.lit(True)
    for r in rules:
        value = m[r.numerator].cast("double")
        if r.denominator:
            value = F.when(m[r.denominator] > 0, value / m[r.denominator])
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (value >= F.lit(float(r.least)))
        if r.most is not None:
            ok = ok & (value <= F.lit(float(r.most)))
        verdict = verdict & ((m["n_words"] < r.from_words) | F.coalesce(ok, F.lit(True)))
    return verdict


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaimed", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_stop_words", "n_repeat_words")


def verdict(text: Column, rules=RULES) -> Column:
    """Struct of the measures, ``base_failed`` and ``kept``."""
    judged = lambda m: F.struct(*[m[k].alias(k) for k in MEASURES], base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(m, rules)).alias("kept"))
    return _let(measures(text), judged)


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Documents with their measures, ``base_failed`` and ``kept``.

    Empty or null texts fail the base rule; a text is measured whole, however long, and an empty table gives none. Repeated rows and ids are judged row by row. Columns of
    the input named as an added column are replaced; others pass through, whatever their names.
    """
    added = (*MEASURES, "base_failed", "kept")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    judged = fresh(docs, "_verdict")
    return docs.select(*own, verdict(F.col(text), rules).alias(judged)).select(*own, *[F.col(f"{judged}.{c}").alias(c) for c in added])
