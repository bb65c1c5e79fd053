"""Licence scans by canonical digest lookup.

A text is brought to a canonical form - lower case, one spelling of equivalent words, single
spaces for everything else but letters and digits, no copyright notice before the words with
which a known licence opens - and the digest of the whole form is joined with the digests of
known licences. The form knows words alone, so line breaks make no difference to it. The
units that are looked up are a document's whole text, its paragraphs and its lines.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm.common import pick, stored

# Notices and short licence texts by SPDX identifier; whole texts follow below.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not '
     "use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]

TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
          "ISC": ["ISC License"],
          "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
          "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License']}


def whole_texts() -> list[tuple[str, str]]:
    """Standard whole texts: the files of ``license_texts``, each as it stands; and the short
    permissive ones, which are spread in several layouts, with and without their title, a
    line that reserves all rights, and numbers before their conditions."""
    folder = Path(__file__).resolve().parent / "license_texts"
    files = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]
    texts = dict(files)
    short = {i: t for i, t in KNOWN if len(t) > 500}
    two = texts["BSD-2-Clause"].partition("\n")[2]
    end = two.index("THIS SOFTWARE")
    short["BSD-2-Clause"] = two
    short["BSD-3-Clause"] = (
        two[:end] + "3. Neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific "
        "prior written permission.\n\n" + two[end:])
    out = []
    for name, text in short.items():
        for body in dict.fromkeys((text, re.sub(r"(?m)^\d\. ", "", text))):
            for rights in ("", "All rights reserved.\n\n"):
                out += [(name, f"{title}\n\n{rights}{body}") for title in ("", *TITLES[name])]
    return files + out


# Before the last entry, which stays the plain text of MIT.
KNOWN[-1:-1] = whole_texts()

# Spellings that count as one word, after lower-casing.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("labelling", "labeling"), ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"), ("percent", "per cent"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"),
]
PARAGRAPH = r"\n[ \t\r]*\n"
# Stands between paragraphs while a whole text is brought to its form; a text's own ones
# become a point, which is as little a letter or digit.
MARK = "\x01"


# Words that make of "copyright" no notice; words that a title before a notice, and the
# notice itself with all its holders, may have.
NO_NOTICE = "notice|notices|holder|holders|owner|owners|law|laws|license|licenses|statement|statements"
TITLE_WORDS, NOTICE_WORDS, OPENING_WORDS = 12, 100, 8


def openings(known: list[tuple[str, str]] = KNOWN) -> list[str]:
    """The first words of the known texts in canonical form, but for those that begin with a
    notice of their own."""
    first = set()
    for _, text in known:
        words = re.sub(r"[\W_]+", " ", text.lower()).split()[:2 * OPENING_WORDS]
        form = " ".join([dict(EQUIVALENT).get(w, w) for w in words]).split()[:OPENING_WORDS]
        if form and form[0] not in ("copyright", "c"):
            first.add(" ".join(form))
    return sorted(first)


# A title, a notice, and behind it the opening of a known text.
NOTICE = (rf"^((?>(?:\S+ ){{0,{TITLE_WORDS}}}?(?=copyright (?!(?:{NO_NOTICE}) )|c (?:19|20)\d\d )))"
          rf"\S+ (?:\S+ ){{0,{NOTICE_WORDS}}}?(?=(?:{'|'.join(openings())})(?: |$))")


def worded(text: Column) -> Column:
    """Lower-case words of a text, each between two spaces of its own; line ends stay and
    paragraphs are parted by MARK."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(".")), PARAGRAPH, f"\n{MARK}\n")
    plain = F.replace(F.lower(marked), F.lit("©"), F.lit(" c "))
    words = F.regexp_replace(plain, r"[^\p{L}\p{N}\n\x01]+", "  ")
    return F.concat(F.lit("  "), F.replace(words, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))


def spelled(words: Column) -> Column:
    """``worded`` text with one spelling of equivalent words; few texts hold another."""
    form = words
    for variant, standard in EQUIVALENT:
        form = F.replace(form, F.lit(f" {variant} "), F.lit(f" {standard} "))
    other = " (?:" + "|".join(variant for variant, _ in EQUIVALENT) + ") "
    return F.when(F.rlike(words, F.lit(other)), form).otherwise(words)


def tidy(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n\x01]+", " "))


def without_notice(form: Column) -> Column:
    """A ``tidy`` text without the notice before its opening. The words of the notice are
    looked for at the beginning alone, so a licence that speaks of copyright keeps its own."""
    return F.when(F.rlike(form, F.lit(rf"^(?:\S+ ){{0,{TITLE_WORDS}}}(?:copyright|c) ")),
                  F.regexp_replace(form, NOTICE, "$1")).otherwise(form)


def canonical(text: Column) -> Column:
    """The canonical form of a licence text; null stays null."""
    return without_notice(tidy(spelled(worded(text))))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license_id, digest) of the known texts, one row per digest."""
    rows = spark.createDataFrame(known, "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(
        F.min("license_id").alias("license_id"))


def licenses(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, whole_license, licenses, n_units) of every row: the licence that the whole
    text is, all licences of its units in order joined by commas, and the number of units
    that are one.

    A copyright notice, with or without a title before it, is no part of a licence where a
    known text opens behind it, however the lines are broken; other words of a text count.
    Null, empty and wordless texts have no licence: empty forms are never looked up. The
    result of a row depends on its text alone, so units are gathered by id and text hash;
    repeated rows get the same result each. An empty table gives an empty result.
    """
    rows = pick(documents, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    # Written, the known digests have a size by which Spark decides about a broadcast.
    known = stored(known.select("digest", "license_id"), "licenses")
    # A text is brought to its form once; its lines and paragraphs are cut from that.
    forms = (rows.select("doc_id", "h", worded(F.col("text")).alias("words"))
             .select("doc_id", "h", spelled(F.col("words")).alias("form")))
    units = F.concat(F.array("form"), F.split("form", MARK), F.split("form", "\n"))
    found = (forms.select("doc_id", "h", F.posexplode(units).alias("at", "unit"))
             .select("doc_id", "h", "at", tidy(F.col("unit")).alias("form")).where("form <> ''")
             .withColumn("form", without_notice(F.col("form")))
             .select("doc_id", "h", (F.col("at") == 0).alias("is_whole"),
                     F.sha2("form", 256).alias("digest"))
             .join(known, "digest"))
    per_row = stored(found.groupBy("doc_id", "h").agg(
        F.max(F.when(F.col("is_whole"), F.col("license_id"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
        F.size(F.collect_set("digest")).alias("n_units"))
        .withColumnRenamed("doc_id", "f_id").withColumnRenamed("h", "f_h"), "licensed")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    return rows.select("doc_id", "h").join(per_row, same, "left").select(
        "doc_id", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units"))
