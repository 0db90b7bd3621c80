"""License scans by canonical digest lookup, by DataFrame operations only (operator 5).

A text is normalised (case, punctuation, copyright lines, equivalent spellings), digested whole and
hash-joined to the digests of known license texts and notices. The whole document is one unit and
each of its lines is another, because notices stand on lines of their own. Whole license texts are also
looked up inside documents, by windows that begin with their first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known notices and short license texts by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
_ISC, _MIT = KNOWN[-2][1], KNOWN[-1][1]
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n",
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_NO_WARRANTY = _MIT[_MIT.index("THE SOFTWARE IS") :]
_ISC_0 = _ISC[: _ISC.index(", provided that")] + ".\n" + _ISC[_ISC.index("THE SOFTWARE IS") :]
_MIT_0 = _MIT[: _MIT.index(", subject to")] + ".\n" + _NO_WARRANTY
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
) + _NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software "
    "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    "machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
    "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)


def _bsd(clauses: int) -> list[str]:
    lists = ["".join(f"{mark.format(i + 1)}{c}" for i, c in enumerate(_BSD_CLAUSES[:clauses])) for mark in ("", "{}. ")]
    return [_BSD_HEAD + x + _BSD_END.format(who) for x in lists for who in ("HOLDER", "OWNER")]


#: Whole texts of common short licenses, found as a whole (also below a title) and anywhere inside a document.
TEXTS = [("ISC", _ISC), ("MIT", _MIT), *(("BSD-2-Clause", x) for x in _bsd(2)), *(("BSD-3-Clause", x) for x in _bsd(3)), ("Zlib", _ZLIB), ("0BSD", _ISC_0), ("MIT-0", _MIT_0), ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST)]
TITLES = {
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"], "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"], "Zlib": ["zlib License", "The zlib License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "MIT-0": ["MIT No Attribution"], "Unlicense": ["The Unlicense", "Unlicense"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: Last lines with which some are published, as whole texts too.
ENDINGS = {"Unlicense": ["For more information, please refer to <https://unlicense.org>", "For more information, please refer to <http://unlicense.org/>"]}
#: Words with which a window inside a document starts.
ANCHOR_WORDS = 4
#: Spellings that count as equal, applied in this order to lower-cased words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("v", "version"), ("creative commons", "cc"), ("attribution", "by")]
COPYRIGHT_LINE = r"(?md)^[^0-9A-Za-z\n]*(?:copyright|all rights reserved)[^\n]*$"
#: Of those lines, the ones that state a copyright; a wrapped sentence of a license may begin with `copyright notice`.
STATEMENT = COPYRIGHT_LINE.replace("copyright", r"copyright(?![^0-9a-z\n]+(?:notice|holder|owner|law|license|licence|interest|statement)s?(?![0-9a-z]))")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: All ASCII characters but letters, digits, the space and the line feed.
_MARKS = r"\x00-\x09\x0b-\x1f\x21-\x2f\x3a-\x60\x7b-\x7f"


def _words(text: Column) -> Column:
    """A-Z lower-cased, copyright statements gone, what parts words made one space; line ends stay."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), STATEMENT, " ")
    return F.regexp_replace(out, rf" ?[{_MARKS}][ {_MARKS}]*+|  [ {_MARKS}]*+", " ")


def _spelled(words: Column) -> Column:
    """SPELLINGS put in one form in words that have one space between them, and one or more at both ends of a line."""
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return words


def _whole(words: Column) -> Column:
    return F.trim(_spelled(F.concat(F.lit(" "), F.trim(F.regexp_replace(words, r" ?\n[ \n]*+", " ")), F.lit(" "))))


def _lines(words: Column) -> Column:
    """The form of each line; no spelling reaches from one line into another."""
    apart = F.concat(F.lit(" "), F.regexp_replace(words, r" ?\n ?", " \n "), F.lit(" "))
    return F.transform(F.split(_spelled(apart), "\n"), lambda line: F.trim(line))


def canonical(text: Column) -> Column:
    """Normal form of a whole text: A-Z lower-cased, copyright statements gone, words joined by one space.

    Words are runs of ASCII letters, digits and non-ASCII characters; all other characters part
    words. Then SPELLINGS are put in one form. Empty if nothing is left; null for null.
    """
    return _whole(_words(text))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """The fixed list as ``license, digest``: a few dozen rows, whatever the corpus."""
    titled = [(name, f"{title}\n{text}") for name, text in TEXTS for title in TITLES[name]]
    ended = [(name, f"{text}\n{end}") for name, text in TEXTS + titled for end in ENDINGS.get(name, [])]
    rows = spark.createDataFrame(known if known is not None else KNOWN + TEXTS + titled + ended, "license string, text string")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).where(F.length("digest") > 0).distinct()


def _from_anchor(spaced: Column, anchor: str, length: int) -> Column:
    """What starts with each occurrence of ``anchor``, ``length`` characters of it, if a word ends there."""
    pieces = F.split(spaced, anchor)
    reach = F.lit(2 + length // len(anchor))  # so many pieces hold a window
    starts = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.substring(F.concat(F.lit(anchor), F.array_join(F.slice(pieces, i, reach), anchor)), 2, length + 1))
    return F.transform(F.filter(parts, lambda p: p.endswith(" ")), lambda p: F.trim(p))


def _windows(whole: Column, spark: SparkSession) -> Column:
    """Parts of a canonical text that begin like one of TEXTS and are as long as it, at every place."""
    rows = spark.createDataFrame(TEXTS, "license string, text string").select(canonical(F.col("text")).alias("form")).distinct().collect()
    spaced = F.concat(F.lit(" "), whole, F.lit(" "))
    keys = sorted({(" " + " ".join(form.split()[:ANCHOR_WORDS]) + " ", len(form)) for (form,) in rows})
    none = F.array().cast("array<string>")
    found = [F.when(F.contains(spaced, F.lit(anchor)), _from_anchor(spaced, anchor, length)).otherwise(none) for anchor, length in keys]
    return F.concat(*found)


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses of every document: ``id_col, licenses, n_matches, whole_text``, one row per input row.

    Units are the whole text and, if it has several lines, each line; also every part of the text that
    begins like one of TEXTS and is as long, which counts unless the whole or a line is that license.
    ``licenses`` are sorted distinct identifiers joined by commas (empty if none), ``n_matches``
    counts units that are a known text, ``whole_text`` says whether a whole document is one. Null and
    empty texts match nothing. Rows that share an id, null included, get what all of them match
    together. Only the fixed list is broadcast, and only matches and ids are shuffled, never texts.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    words = rows.select("_id", _words(F.col("_text")).alias("_words"))
    lines = F.when(F.contains("_words", F.lit("\n")), _lines(F.col("_words"))).otherwise(F.array().cast("array<string>"))
    forms = words.select("_id", F.concat(F.array(_whole(F.col("_words"))), lines).alias("_forms"))
    forms = forms.select("_id", F.transform("_forms", lambda x: F.sha2(x, 256)).alias("_digests"), F.transform(_windows(F.col("_forms")[0], docs.sparkSession), lambda x: F.sha2(x, 256)).alias("_inside"))
    both = F.concat(F.transform("_digests", lambda x, i: F.struct(i.alias("at"), x.alias("digest"))), F.transform("_inside", lambda x: F.struct(F.lit(-1).alias("at"), x.alias("digest"))))
    digests = forms.select("_id", F.explode(both).alias("u")).select("_id", F.col("u.at").alias("_at"), F.col("u.digest").alias("digest"))
    found = (
        digests.join(F.broadcast(known.groupBy("digest").agg(F.min("license").alias("license"))), "digest")
        .groupBy("_id", "license")
        .agg(F.count_if(F.col("_at") >= 0).alias("n"), F.count("*").alias("n_inside"), F.max(F.col("_at") == 0).alias("w"))
        .groupBy("_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n_inside"))).alias("n_matches"),
            F.max("w").alias("whole_text"),
        )
    )
    ids = docs.select(F.col(id_col).alias("_doc"))
    out = ids.join(found, ids["_doc"].eqNullSafe(found["_id"]), "left")
    return out.select(
        F.col("_doc").alias(id_col),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("whole_text", F.lit(False)).alias("whole_text"),
    )
