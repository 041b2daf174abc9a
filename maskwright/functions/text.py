"""Text expressions: trimming, boundaries, term patterns, positions, spans and names, all as Spark columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits as Python's [^\W_] has them, and with the underscore as \w.
ALNUM = r"\p{L}\p{N}"
WORD = ALNUM + "_"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def trim_py(text: Column) -> Column:
    """Strip every white space at both ends, as Python's str.strip does."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def quoted(term: str) -> str:
    """A Java pattern that matches the term literally."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def term_pattern(term: str, underscore_joins: bool = False) -> str:
    """Case-insensitive whole-term pattern.

    Detection counts an underscore as part of a word; replacement takes it as a boundary.
    """
    edge = WORD if underscore_joins else ALNUM
    return f"(?iu)(?<![{edge}]){quoted(term)}(?![{edge}])"


def term_pattern_column(term: Column, underscore_joins: bool = False) -> Column:
    """``term_pattern`` of a column of terms, with the term first: edges are looked at only where it is."""
    edge = WORD if underscore_joins else ALNUM
    inner = F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"(?iu)\Q"), inner, F.lit(rf"\E(?<![{edge}]\Q"), inner, F.lit(rf"\E)(?![{edge}])"))


def term_present(text: Column, term: Column) -> Column:
    return F.rlike(text, term_pattern_column(term, True))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(body, *columns: str) -> Column:
    """``body`` of columns that its own functions of elements use: bound outside of them, so that no plan puts a column's expression inside and works it out for each element."""
    return let(F.struct(*columns), lambda b: body(*[b[c] for c in columns]))


def exploded(df: DataFrame, keep: tuple[str, ...], items: Column | str, name: str = "e", pos: str = "_pos") -> DataFrame:
    """``keep`` and one row for each element of ``items``, with its place.

    Of a plain explode Spark infers a filter on the array's size, pushes it below all projections and so works out the array, with all that it is made of, once more.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, name))
    return rows.filter(F.col(pos).isNotNull())


#: Elements up to which a list of all sums so far is simply appended to.
SHORT = 256


def scan(values: Column, combine, zero: Column) -> Column:
    """``combine`` of all elements before each, by position, without shuffles.

    A short list is one fold; of a longer one, blocks are combined, then blocks of blocks: an array of a hundred thousand costs a few steps for each element.
    """
    start = F.struct(F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("before"), zero.alias("so_far"))
    step = lambda acc, x: F.struct(F.concat(acc["before"], F.array(acc["so_far"])).alias("before"), combine(acc["so_far"], x).alias("so_far"))
    return let(values, lambda a: F.when(F.size(a) <= SHORT, F.aggregate(a, start, step, lambda acc: acc["before"])).otherwise(_scan_blocks(a, combine, zero)))


def _scan_blocks(values: Column, combine, zero: Column, levels: int = 2, width: int = 32) -> Column:
    fold = lambda a: F.aggregate(a, zero, combine)
    if not levels:
        return let(values, lambda a: F.transform(a, lambda _, i: fold(F.slice(a, F.lit(1), i))))

    def with_blocks(a: Column) -> Column:
        n_blocks = F.ceil(F.size(a) / F.lit(width)).cast("int")
        starts = F.slice(F.sequence(F.lit(0), n_blocks), F.lit(1), n_blocks)
        blocks = F.transform(starts, lambda k: fold(F.slice(a, k * width + 1, F.lit(width))))
        at = lambda i: F.floor(i / F.lit(width)).cast("int")
        return let(
            _scan_blocks(blocks, combine, zero, levels - 1, width),
            lambda before: F.transform(a, lambda _, i: combine(F.get(before, at(i)), fold(F.slice(a, at(i) * width + 1, F.pmod(i, F.lit(width)))))),
        )

    return let(values, with_blocks)


def running_sum(values: Column) -> Column:
    """Sum of the elements before each of an array<int>."""
    return scan(values, lambda x, y: x + y, F.lit(0))


def firsts(items: Column, key) -> Column:
    """The first element of each key, in order: sorted by key, neighbours compared, sorted back."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    first = let(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: x["i"])), lambda i: F.get(items, i))


def positions(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,entity>> of all matches, in code points, half open."""
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def place(p: Column) -> Column:
        steps = F.transform(p["hit"], lambda h, i: F.length(F.get(p["gap"], i)) + F.length(h))
        return let(
            running_sum(steps),
            lambda before: F.transform(
                p["hit"],
                lambda h, i: let(
                    F.get(before, i) + F.length(F.get(p["gap"], i)), lambda s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("entity"))
                ),
            ),
        )

    return let(parts, place)


def emails(text: Column) -> Column:
    """Addresses in a text, the first spelling of each, with its place: array<struct<start,end,entity>>."""
    found = let(positions(text, F.lit(EMAIL)), lambda found: firsts(found, lambda x: F.lower(x["entity"])))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<struct<start:int,end:int,entity:string>>"))


def greedy_spans(spans: Column, better) -> Column:
    """Keep spans in the order of ``better`` (a comparator of two) unless they overlap a kept one; sorted by start.

    Spans none of which overlaps the next all stay. Others are first parted where none reaches across, and the choice is made within each part of several.
    """
    by_start = lambda a: F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["start"].alias("s"), x.alias("x")))), lambda k: k["x"])

    def choose(part: Column) -> Column:
        return F.aggregate(
            F.transform(F.array_sort(part, better), lambda x: F.array(x)),
            F.slice(part, F.lit(1), F.lit(0)),
            lambda acc, x: F.when(F.exists(acc, lambda k: (x[0]["start"] < k["end"]) & (x[0]["end"] > k["start"])), acc).otherwise(F.concat(acc, x)),
            by_start,
        )

    def parted(s: Column) -> Column:
        reach = scan(F.transform(s, lambda x: x["end"].cast("int")), lambda x, y: F.greatest(x, y), F.lit(-1))
        opens = let(reach, lambda r: F.filter(F.transform(s, lambda x, i: F.when(x["start"] >= F.get(r, i), i)), lambda i: i.isNotNull()))
        one = lambda part: F.when(F.size(part) > 1, choose(part)).otherwise(part)
        return let(opens, lambda o: F.flatten(F.transform(o, lambda i, k: let(F.slice(s, i + 1, F.coalesce(F.get(o, k + 1), F.size(s)) - i), one))))

    clash = lambda s: F.exists(F.transform(s, lambda x, i: (i > 0) & (x["start"] < F.get(s, i - 1)["end"])), lambda c: c)
    return let(by_start(spans), lambda s: F.when(clash(s), parted(s)).otherwise(s))


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def by_length_then_score(a: Column, b: Column) -> Column:
    """Longer first, then the higher score, then the earlier in the list (``seq``)."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return F.when(la != lb, _sign(lb, la)).when(a["score"] != b["score"], _sign(b["score"], a["score"])).otherwise(_sign(a["seq"], b["seq"]))


def by_confidence(a: Column, b: Column) -> Column:
    return F.when(a["confidence"] != b["confidence"], _sign(b["confidence"], a["confidence"])).otherwise(_sign(a["seq"], b["seq"]))


def split_on_newlines(entity: Column, start: Column) -> Column:
    """Pieces of a span, one for each line, stripped, with exact offsets; blank lines vanish."""

    def place(p: Column) -> Column:
        lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", ""))
        cut = lambda before: F.transform(
            p,
            lambda x, i: let(
                (start + F.get(before, i) + lead(x)).cast("int"),
                lambda s: F.struct(trim_py(x).alias("entity"), s.alias("start"), (s + F.length(trim_py(x))).cast("int").alias("end")),
            ),
        )
        return F.filter(let(running_sum(F.transform(p, lambda x: F.length(x) + 1)), cut), lambda c: c["entity"] != "")

    return let(F.split(entity, "\n"), place)


def distinct_terms(terms: Column) -> Column:
    """Trimmed, non-empty terms; of spellings that differ by case the first."""
    return let(F.filter(F.transform(terms, trim_py), lambda t: t != ""), lambda a: firsts(a, F.lower))


def split_terms(raw: Column) -> Column:
    """Terms of a typed list: parted by commas, semicolons and line ends."""
    return F.filter(F.transform(F.split(raw, r"[,\n;]+"), trim_py), lambda t: t != "")


# Accents that a slug folds.
ACCENTS, PLAIN = "àâäãéèêëîïôöùûüç", "aaaaeeeeiioouuuc"


def slug(name: Column, default: str = "client") -> Column:
    folded = F.translate(trim_py(F.lower(name)), ACCENTS, PLAIN)
    out = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def file_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".docx"), "docx").when(low.endswith(".pptx"), "pptx")


def content_type(kind: Column) -> Column:
    base = "application/vnd.openxmlformats-officedocument."
    return F.when(kind == "docx", base + "wordprocessingml.document").when(kind == "pptx", base + "presentationml.presentation")


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def rename_stem(name: Column) -> Column:
    """As ``stem``, but a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """What ``rename_stem`` leaves off, with its dot."""
    return F.substring(name, F.length(rename_stem(name)) + 1, F.length(name))


def safe_name(name: Column) -> Column:
    """A name that any browser and file system takes: brackets, dashes, reserved characters, white space and final dots."""
    out = F.translate(name, "[]–—", "()--")
    out = F.regexp_replace(out, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " ")
    out = F.rtrim(trim_py(out), F.lit("."))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("document"))


def keep_title(name: Column) -> Column:
    """The name with _ANO before its extension."""
    marked = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"(?s)^(.*)\.([^.]*)$", "$1_ANO.$2")).otherwise(F.concat(name, F.lit("_ANO")))
    return safe_name(marked)


def flag(value: Column) -> Column:
    """A form's yes."""
    return F.lower(value).isin("true", "1", "yes", "on")


def mapping_type(category: Column) -> Column:
    return F.rtrim(category, F.lit("s"))


# Placeholder label of each category.
LABELS = {"entreprises": "ENTREPRISE", "personnes": "PERSONNE", "lieux": "LIEU", "autres": "SENSIBLE", "alts": "ALT", "mails": "MAIL"}


def label(category: Column) -> Column:
    out = F.lit("SENSIBLE")
    for k, v in LABELS.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def placeholder(category: Column, number: Column) -> Column:
    return F.format_string("[%s_%d]", label(category), number)


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5)).otherwise(0).cast("int")


def byte_size(n: Column) -> Column:
    """Bytes as a person reads them: B, KB or MB."""
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def middle_cut(name: Column, most: int = 40) -> Column:
    """A long name with its middle left out."""
    half = (most - 3) // 2
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.left(name, F.lit(most - 3 - half)), F.lit("..."), F.right(name, F.lit(half))))


def with_numbers(df: DataFrame, items: str, key, category, out: str = "_marks") -> DataFrame:
    """The rows with ``out``: placeholders aligned with an array's items, one for each key, numbered by the label of its first item's category, in order.

    Items are sorted by key, so equal ones are neighbours; first ones are numbered label by label and every item takes its key's by place. No shuffle and no
    look-up by comparing all with all. Steps are columns of their own, as Spark's analysis has a limit on nesting.
    """
    names = F.array(*[F.lit(v) for v in dict.fromkeys(LABELS.values())])
    new = lambda s: F.transform(s, lambda x, j: F.when((j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"]), 1).otherwise(0))
    first = lambda s, n, b: F.transform(s, lambda x, j: F.when(F.get(n, j) == 1, F.struct(x["i"].alias("i"), F.get(b, j).alias("g"), x["l"].alias("l"))))
    of_label = lambda f: F.transform(names, lambda name: F.transform(F.filter(f, lambda x: x["l"] == name), lambda x, n: F.struct(x["g"].alias("g"), F.format_string("[%s_%d]", name, n + 1).alias("m"))))
    steps = [
        ("_s", F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), label(category(x)).alias("l"))))),
        ("_n", bound(new, "_s")),
        ("_b", running_sum(F.col("_n"))),
        ("_g", bound(lambda n, b: F.transform(b, lambda x, j: x + F.get(n, j) - 1), "_n", "_b")),
        ("_f", F.sort_array(F.filter(bound(first, "_s", "_n", "_b"), lambda x: x.isNotNull()))),
        ("_m", F.transform(F.sort_array(F.flatten(bound(of_label, "_f"))), lambda x: x["m"])),
        (out, F.transform(F.sort_array(bound(lambda s, m, g: F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.get(m, F.get(g, j)).alias("m"))), "_s", "_m", "_g")), lambda x: x["m"])),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop("_s", "_n", "_b", "_g", "_f", "_m")


def chunk_spans(text: Column, most: int = 1500) -> Column:
    """array<struct<start,end>>: where paragraphs packed up to ``most`` characters begin and end, in the text with a line end added.

    A fold over paragraph lengths that starts anew where the next would not fit; a longer paragraph stays whole, a text that fits is one chunk (without the line
    end), and a last chunk of nothing but white space is left out.
    """
    cut = lambda acc, n: (acc["size"] > 0) & (acc["size"] + n > most)

    def fold(sizes: Column) -> Column:
        zero = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("size"), F.lit(0).alias("at"))
        step = lambda acc, n: F.struct(F.when(cut(acc, n), F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"), F.when(cut(acc, n), n).otherwise(acc["size"] + n).alias("size"), (acc["at"] + n).alias("at"))
        spans = lambda acc: F.transform(acc["cuts"], lambda a, k: F.struct(a.alias("start"), F.coalesce(F.get(acc["cuts"], k + 1), acc["at"]).alias("end")))
        return F.aggregate(sizes, zero, step, spans)

    packed = let(F.transform(F.split(text, "\n"), lambda p: F.length(p) + 1), fold)
    last_blank = lambda s: trim_py(F.substring(text, F.element_at(s, -1)["start"] + 1, F.length(text))) == ""
    many = let(packed, lambda s: F.when(last_blank(s), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s))
    return F.when(F.length(text) <= most, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))).otherwise(many)


#: Signs of a window in which a long text is cut, so that a piece costs its window and not the text.
WINDOW = 2048


def pieces_of(text: Column, body) -> Column:
    """``body(cut)`` where ``cut(a, b)`` is the text from place a to before b."""
    windows = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / F.lit(WINDOW)).cast("int")), lambda w: F.substring(text, w * WINDOW + 1, F.lit(WINDOW)))

    def cut(w: Column):
        def one(a: Column, b: Column) -> Column:
            first, last = F.floor(a / F.lit(WINDOW)).cast("int"), F.floor(F.greatest(a, b - 1) / F.lit(WINDOW)).cast("int")
            return F.substring(F.array_join(F.slice(w, first + 1, last - first + 1), ""), a - first * WINDOW + 1, F.greatest(b - a, F.lit(0)))

        return one

    return let(windows, lambda w: body(cut(w)))


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, mark), in order and without overlaps, turned into its mark."""

    def build(cut):
        def join(s: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(F.lit(0))
            parts = F.transform(s, lambda x, i: F.concat(cut(before(i), x["start"]), x["mark"]))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(s, -1)["end"], F.length(text)))

        return let(spans, lambda s: F.when(F.size(s) > 0, join(s)).otherwise(text))

    return pieces_of(text, build)


#: Bytes of rows that a Python step works on at one time.
PART = 2 << 20


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PART`` bytes, so that what Python makes of its rows doesn't grow with the rows that a batch may have."""
    rows = max(1, PART * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
