"""Licence scan: canonical digests of entire texts, joined to the digests of known licences.

The longer known texts are files of ``licenses``, one published text each, named by licence id.
"""

from __future__ import annotations

import re
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, shared_dir

# Published licence texts and the usual one-line notices, by licence id.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
KNOWN_TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.\n\n" + _BSD_END,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# Spellings taken as equal.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
)

# Titles that a licence file may or may not begin with, in canonical form, longer ones before their beginnings.
TITLES = (
    "the mit license mit", "the mit license", "mit license mit", "mit license",
    "the isc license isc", "the isc license", "isc license isc", "isc license",
    "the bsd 2 clause license", "bsd 2 clause simplified license", "bsd 2 clause license", "simplified bsd license",
    "the bsd 3 clause license", "bsd 3 clause new or revised license", "bsd 3 clause license", "new bsd license",
    "bsd zero clause license", "zero clause bsd license", "zero clause bsd",
)
# Words after "copyright" that go on with a sentence instead of naming a holder.
NOT_HOLDERS = "holders?|owners?|notices?|licen[sc]es?|laws?|statements?|disclaimers?|interests?|and|or|in|to|is|of"

#: Most known texts that lines are looked up in by a literal set; beyond it lines are joined by digest.
MOST_NOTICES = 10_000
#: Most words by which lines are sieved before they are hashed.
MOST_MARKERS = 200
#: A whole line that only states a copyright (a sign, a year or a name follows, or it is the first line) or that all rights are reserved.
COPYRIGHT_LINE = (
    r"(?md)\A[ \t]*\([cC]\)[^\n]*|^[ \t]*(?:(?i:copyright)[ \t]*(?:\([cC]\)|©)|©|(?:(?i:copyright)|\([cC]\))[ \t:]+(?:[0-9]{4}|[<\[]?(?i:year|yyyy))"
    rf"|(?i:copyright)[ \t]+(?!(?i:{NOT_HOLDERS})(?![\p{{L}}\p{{N}}]))\p{{Lu}}|(?i:all rights reserved)[.]?[ \t]*$)[^\n]*"
)
NOT_TEXT = r"[^\p{L}\p{N}]+"


def shipped_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the files, whole and, where one marks the end of its terms, also without what follows that."""
    end = "END OF TERMS AND CONDITIONS"
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if end in text:
            out.append((path.stem, text[: text.index(end) + len(end)]))
    return out


def all_texts() -> list[tuple[str, str]]:
    return [*KNOWN_TEXTS, *shipped_texts()]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, title and punctuation, in one spelling, words one space apart."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    out = F.trim(F.regexp_replace(out, NOT_TEXT, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, f"^(?:{'|'.join(TITLES)}) ", "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """(license_digest, license_id, marker), one row for each digest of (id, text) pairs, by default all that are shipped.

    ``marker`` is the longest word of the canonical text that no equal spelling touches: a line that equals the text has it, or null.
    """
    pairs = all_texts() if texts is None else list(texts)
    rows = spark.createDataFrame(pa.table({"license_id": pa.array([i for i, _ in pairs], pa.string()), "_known": pa.array([t for _, t in pairs], pa.string())}))
    touched = {w for _, new in SPELLINGS for w in new.split()}
    known: dict[str, tuple] = {}
    for license_id, text in sorted(tuple(r) for r in rows.select("license_id", canonical(F.col("_known"))).collect()):
        free = [w for w in text.split() if not any(t in w for t in touched)]
        if text:
            known.setdefault(sha256(text.encode()).hexdigest(), (license_id, max(free, key=len, default=None)))
    columns = zip(("license_digest", "license_id", "marker"), ([d for d in known], [v[0] for v in known.values()], [v[1] for v in known.values()]))
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.string()) for name, values in columns}))


def _sieve(markers: list[str | None]):
    """A test that every line equal to a known text passes; all lines pass if some text has no marker or markers are many."""
    words = set(markers)
    if None in words or len(words) > MOST_MARKERS:
        return lambda line: line.rlike(r"[\p{L}\p{N}]")
    return lambda line: F.lower(line).rlike("|".join(re.escape(w) for w in sorted(words)) or "(?!)")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: text_digest, license_id of its entire text (or null), notices and n_notices.

    ``notices`` joins with "," the sorted distinct ids of the licences whose known text equals one
    of the document's lines. A null text, and a text or line without a letter or digit, matches nothing; its digest is null.
    Whole texts are hashed, however long. Repeated rows give repeated rows, a null id stays null, an empty table gives no rows, and no other column of the
    input, whatever its name, is read. Entire texts are hash-joined: Spark broadcasts ``known`` only under its own size threshold and
    otherwise shuffles by digest. Lines are looked up in place in a literal set of up to ``MOST_NOTICES`` digests; for more known texts they are joined by digest too.
    """
    table = known.limit(MOST_NOTICES + 1).collect()
    whole_known = known.select(F.col("license_digest").alias("text_digest"), "license_id")
    body = docs.select(F.col(id_col), F.col(text).alias("_t"))
    whole = canonical(F.col("_t"))
    text_digest = F.when(whole != "", F.sha2(whole, 256)).alias("text_digest")
    none = F.array().cast("array<string>")
    if len(table) <= MOST_NOTICES:
        digests = [r.license_digest for r in table]
        ids = F.create_map(*[F.lit(x) for r in table for x in (r.license_digest, r.license_id)]) if table else F.create_map().cast("map<string,string>")
        line_digests = F.transform(F.filter(F.split("_t", "\n"), _sieve([r.marker for r in table])), digest)
        found = F.transform(F.filter(line_digests, lambda d: d.isin(digests)), lambda d: F.element_at(ids, d))
        scanned = body.select(id_col, text_digest, F.coalesce(F.array_sort(F.array_distinct(found)), none).alias("_ids"))
    else:
        scanned = save(body.select(id_col, text_digest, F.monotonically_increasing_id().alias("_row"), F.array_distinct(F.transform(F.split("_t", "\n"), digest)).alias("_lines")), shared_dir(docs.sparkSession, "license"))
        lines = scanned.select("_row", F.explode("_lines").alias("license_digest")).join(known.select("license_digest", "license_id"), "license_digest")
        ids = lines.groupBy("_row").agg(F.array_sort(F.collect_set("license_id")).alias("_ids"))
        scanned = scanned.drop("_lines").join(ids, "_row", "left").withColumn("_ids", F.coalesce("_ids", none))
    return scanned.join(whole_known, "text_digest", "left").select(
        id_col, "text_digest", "license_id", F.array_join("_ids", ",").alias("notices"), F.size("_ids").cast("long").alias("n_notices")
    )
