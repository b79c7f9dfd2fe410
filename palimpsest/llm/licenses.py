"""License scans: canonical digests of whole texts, and of single lines, looked up among known licenses' digests.

The canonical form is lower case, without copyright lines, with equivalent spellings made one and every run of other
characters than letters and digits, of any script, a single blank.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Spellings that licence matching treats alike (fixed values): each first one becomes the second.
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-commercial": "noncommercial",
    "merchantibility": "merchantability",
    "acknowledgement": "acknowledgment",
    "judgement": "judgment",
    "organisation": "organization",
    "initialise": "initialize",
    "per cent": "percent",
    "https:": "http:",
    "©": "(c)",
}
COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|:|[0-9]{4})|\(c\)[ \t]*(copyright[ \t]*)?[0-9]{4})[^\n]*"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted{0}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
#: Public licence texts (fixed values), each with and without its title.
TEXTS = {
    "MIT": f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}",
    "MIT-0": f"{_GRANT}.\n{_WARRANTY}",
    "ISC": _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD": _ISC.format(""),
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
}
TITLES = {"MIT": "MIT License", "MIT-0": "MIT No Attribution", "ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
#: Canonical digests of longer public texts (fixed values), as in common distributions of them.
DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
#: Notices that stand for a licence in a line of their own (fixed values).
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "All rights reserved.": "all-rights-reserved",
}


def canonical_text(text: str) -> str:
    """The canonical form, for known texts."""
    text = text.lower()
    for a, b in SPELLINGS.items():
        text = text.replace(a, b)
    return re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT, "\n", text)).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known() -> tuple[dict[str, str], dict[str, str]]:
    """Licences by digest of the whole text, and by digest of a line."""
    whole = {d: k for k, d in DIGESTS.items()} | {digest(n): k for n, k in NOTICES.items()}
    for k, t in TEXTS.items():
        whole |= {digest(t): k, digest(f"{TITLES[k]}\n\n{t}"): k}
    return whole, {digest(n): k for n, k in NOTICES.items()}


def _canonical(text: Column) -> Column:
    """The canonical form but for its line ends, as a column."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(text, COPYRIGHT, "\n"), r"[^\p{L}\p{N}\n]+", " ")


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical form of a whole text."""
    return F.sha2(F.trim(F.regexp_replace(_canonical(text), "[ \n]+", " ")), 256)


def known_digests(texts: DataFrame) -> DataFrame:
    """(license, text) -> (digest, license), for `scan`; of several names of one text the first by code point."""
    return texts.where("text is not null").groupBy(canonical_digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known_table: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, notices for each row of docs.

    digest is SHA-256 of the whole text's canonical form, license the known licence with that digest, or null; notices
    names the licences that single lines stand for, sorted and joined by commas. A null text counts as empty and matches
    nothing. known_table, (digest, license) with one row a digest, stands for the built-in few dozen; either is broadcast
    if its counted rows are few, else the join is shuffled. Extra columns are not read.
    """
    spark = docs.sparkSession
    whole, lines = known()
    table = spark.createDataFrame(sorted(whole.items()), "digest string, license string") if known_table is None else known_table.select("digest", "license")
    table = small(table, len(whole) if known_table is None else table.count())
    named = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair])
    df = docs.select("doc_id", _canonical(F.col("text")).alias("text"))
    digests = F.transform(F.split("text", "\n"), lambda x: F.sha2(F.trim(x), 256))
    found = F.array_intersect(digests, F.array(*[F.lit(x) for x in sorted(lines)]))
    found = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.element_at(named, x))))
    df = df.select("doc_id", F.sha2(F.trim(F.regexp_replace("text", "[ \n]+", " ")), 256).alias("digest"), F.array_join(found, ",").alias("notices"))
    return df.join(table, "digest", "left").select("doc_id", "digest", "license", "notices")


def oracle() -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = "lower(COALESCE(text, ''))"
    for a, b in SPELLINGS.items():
        text = f"replace({text}, {quoted(a)}, {quoted(b)})"
    newline = "chr(10)"
    text = f"regexp_replace(regexp_replace({text}, {quoted(COPYRIGHT)}, {newline}, 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    whole, lines = known()
    values = lambda d: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(d.items()))
    return f"""
WITH c AS (SELECT doc_id, {text} AS text FROM documents),
w AS (SELECT doc_id, text, sha256(trim(regexp_replace(text, '[ \\n]+', ' ', 'g'))) AS digest FROM c),
n AS (SELECT DISTINCT w.doc_id, k.license FROM (SELECT doc_id, sha256(trim(unnest(string_split(text, {newline})))) AS digest FROM w) w
  JOIN (VALUES {values(lines)}) k(digest, license) USING (digest)),
j AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM n GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, COALESCE(j.notices, '') AS notices
FROM w LEFT JOIN (VALUES {values(whole)}) k(digest, license) USING (digest) LEFT JOIN j ON w.doc_id = j.doc_id
"""
