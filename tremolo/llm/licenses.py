"""Licence texts by digests of their canonical form.

Canonical form: letters are lower-cased; line breaks within a paragraph become spaces;
a copyright statement ("copyright" with a sign or a year) is dropped up to the words that
open a licence or to the end of its paragraph, and so is "all rights reserved"; every run
of other characters than letters and digits becomes one space; equivalent spellings are
made one; a licence's own title is dropped from the front.  So neither line width nor
owner, year or title matters.  A text equals a known licence if the SHA-256 digests of
both forms are equal.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most known texts; each is one row of the broadcast side and one array entry.
MAX_KNOWN = 5_000

# Spellings that count as equal (left becomes right).
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"), ("wilful", "willful"), ("fulfil ", "fulfill "),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
)

# Words that open a licence, a notice or a part of one.
OPENINGS = (
    "permission is hereby granted", "permission is granted", "permission to use", "redistribution and use",
    "redistributions of source", "everyone is permitted", "licensed under", "licenced under", "released under",
    "this program is free", "this library is free", "this file is part of", "this work is licensed",
    "this program comes with", "gnomovision comes with", "this software is provided", "this is free and unencumbered",
    "to the extent possible under law", "the contents of this file", r"contributor\(s\):",
)

# Titles that stand before a licence's text, in canonical form.
TITLES = (
    "mit license", "mit license mit", "expat license", "isc license", "isc license isc", "bsd zero clause license",
    "zero clause bsd", "0bsd", "bsd license", "new bsd license", "modified bsd license", "simplified bsd license",
    "bsd 2 clause license", "bsd 3 clause license", "bsd 2 clause simplified license",
    "bsd 3 clause new or revised license", "unlicense",
    "apache license version 2 0 january 2004",
    "apache license version 2 0 january 2004 http www apache org licenses",
    "mozilla public license version 1 1", "mozilla public license version 2 0", "artistic license",
    "gnu general public license version 1 february 1989", "gnu general public license version 2 june 1991",
    "gnu general public license version 3 29 june 2007", "gnu library general public license version 2 june 1991",
    "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 3 29 june 2007",
    "gnu free documentation license version 1 2 november 2002", "gnu free documentation license version 1 3 3 november 2008",
    "creative commons legal code cc0 1 0 universal", "cc0 1 0 universal",
)

# Known notices and short texts; whole texts are in ``license_texts``.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)



def whole_texts() -> list[tuple[str, str]]:
    """``(licence, text)`` of the files ``license_texts/<licence>.txt``."""
    files = (resources.files(__package__) / "license_texts").iterdir()
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt"))


_YEAR = r"(?:[0-9]{4}|year\b|yyyy\b)"
_MARKED = rf"(?:copyright *(?:\(c\)|©|[\[<]?{_YEAR})|(?:\(c\)|©) *[\[<]?{_YEAR})"

#: ``(pattern, replacement)``, in order, on the lower-cased text; ``{}`` is the first
#: group.  A paragraph's end is the character 1D.
STEPS = (
    (r"[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\f\n]*", "\x1d"),
    (r"[ \t\r\f\n]+", " "),
    (rf"{_MARKED}[^\x1d]*?({'|'.join(OPENINGS)}|\x1d|\z)", "{}"),
    (r"all rights reserved", ""),
    (r"[^\p{L}\p{N}]+", " "),
)
TITLE = rf"^(?:the )?(?:{'|'.join(sorted(set(TITLES), key=len, reverse=True))}) "


def canonical(text: Column) -> Column:
    """The canonical form; of a null text, the empty form."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for pattern, kept in STEPS:
        plain = F.regexp_replace(plain, pattern, kept.format("$1"))
    plain = F.trim(plain)
    for other, one in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(one))
    return F.regexp_replace(plain, TITLE, "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(
    spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN
) -> list[tuple[str, str]]:
    """``(licence, digest)`` of known texts; the first licence of equal forms."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"{len(known)} known texts; at most {MAX_KNOWN} can be compared")
    rows = spark.createDataFrame(list(enumerate(t for _, t in known)), "at int, text string")
    found: dict[str, str] = {}
    for row in rows.select("at", digest(F.col("text")).alias("d")).orderBy("at").collect():
        found.setdefault(row.d, known[row.at][0])
    return [(name, d) for d, name in found.items()]


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``(doc_id, digest, license, line_licenses)`` of every row of
    ``docs(doc_id, text)``.

    ``known`` are by default ``KNOWN`` and ``whole_texts()``.
    ``license`` is the known licence whose text the whole text is, or null;
    ``line_licenses`` are the licences that single lines are, each once, in
    alphabetic order.  Null and empty texts, and texts of copyright statements only,
    have the digest of the empty form and no licence.  Repeated and null ids are
    kept row by row; no other column is read.  The table of known digests is
    bounded and broadcast, so nothing is shuffled.
    """
    spark = docs.sparkSession
    table = known_digests(spark, [*KNOWN, *whole_texts()] if known is None else known)
    side = spark.createDataFrame(table, "license string, known string")
    by_digest = F.create_map(*[F.lit(x) for name, d in table for x in (d, name)])
    lines = F.transform(F.split("text", "\n"), digest)
    named = F.transform(
        F.array_intersect(lines, F.array(*[F.lit(d) for _, d in table])),
        lambda d: F.element_at(by_digest, d),
    )
    none = F.array().cast("array<string>")
    rows = docs.select(
        "doc_id", digest(F.col("text")).alias("digest"),
        F.coalesce(F.array_sort(F.array_distinct(named)), none).alias("line_licenses"),
    )
    joined = rows.join(F.broadcast(side), rows["digest"] == side["known"], "left")
    return joined.select("doc_id", "digest", "license", "line_licenses")
