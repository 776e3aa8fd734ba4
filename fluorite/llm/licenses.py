"""License scans: digests of canonical texts, joined to those of known licences; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, maybe_broadcast, read

# Spellings that mean the same, as words, and the one that stands for them.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations",
    "authorised": "authorized", "authorisation": "authorization", "recognised": "recognized", "favour": "favor", "behaviour": "behavior", "centre": "center", "cancelled": "canceled",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labour": "labor", "merchantibility": "merchantability", "noncommercial": "non commercial",
    "programme": "program", "redistributions": "redistribution", "utilisation": "utilization", "whilst": "while", "acknowledgement": "acknowledgment", "analogue": "analog", "catalogue": "catalog",
}

# Published licence texts and notices, without their copyright lines.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

# Digests of the canonical texts of longer published licences, by SPDX identifier;
# `python -m fluorite.llm.licenses FOLDER` prints those of a folder of licence texts.
KNOWN_DIGESTS = {
    "Apache-2.0": "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
    "Artistic-1.0-Perl": "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915",
    "BSD-3-Clause-UC": "d822e407f604732181d36ae3a151758376013493c9d52f5a1f49eb740c396123",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",
    "GFDL-1.3": "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",
    "GPL-1.0": "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce",
    "GPL-2.0": "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88",
    "GPL-3.0": "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30",
    "LGPL-2.0": "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d",
    "LGPL-2.1": "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

# One-line notices that name a licence or a claim; they aren't licences themselves.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}

#: A line that only says who has the copyright.
COPYRIGHT = r"(?md)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*+$"


def canonical_lines(text: Column) -> Column:
    """The text in lower case, without copyright lines and punctuation, with one spelling of each word; line breaks stay."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]++", " ")
    words = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    has = t.rlike(r"(?<!\S)(?:" + "|".join(SPELLINGS) + r")(?!\S)")  # few texts pay for their words
    return F.when(has, F.array_join(F.transform(F.split(F.replace(t, F.lit("\n"), F.lit(" \n ")), " "), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")).otherwise(t)


def joined_lines(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r" *+\n[ \n]*+", " "))


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, one blank between words, one spelling of each word."""
    return joined_lines(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of licence texts and of known digests; the published ones if none are given."""
    if texts is None and digests is None:
        texts, digests = KNOWN, KNOWN_DIGESTS
    pair = lambda a, b: T.StructType([T.StructField(a, T.StringType()), T.StructField(b, T.StringType())])
    rows = spark.createDataFrame(sorted((texts or {}).items()), pair("license", "text")).select(digest(F.col("text")).alias("digest"), "license")
    rows = rows.union(spark.createDataFrame([(d, n) for n, d in sorted((digests or {}).items())], pair("digest", "license")))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins digests of canonical whole texts to known licences (digest, license), in one pass over the texts.

    Lines that are a known one-line notice (name: text; a table for the driver)
    are told apart from licences: they only name one.

    Returns id, digest, license (of the whole text, or null), n_notice_lines
    (long) and notices, the sorted names of the notices that lines of the text
    are. A row for each row of docs; null text: digest null, nothing found; a
    text without words has the digest of nothing, which no licence has; repeated
    rows get the same each; long texts are read whole, in time in proportion to
    them; empty input: no rows. Other columns of docs are ignored. Known
    licences are broadcast if they are proven to be few.
    """
    notices = NOTICES if notices is None else notices
    known = maybe_broadcast(materialize(known.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))))
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    none = F.array().cast("array<string>")
    if notices:
        names = F.create_map(*[x for name, line in sorted(notices.items()) for x in (canonical(F.lit(line)), F.lit(name))])
        of = F.transform(F.split("lines", "\n"), lambda line: F.try_element_at(names, F.trim(line)))
        found = F.coalesce(F.filter(of, lambda x: x.isNotNull()), none)
    else:
        found = none
    rows = rows.select("id", F.sha2(joined_lines(F.col("lines")).cast("binary"), 256).alias("digest"), found.alias("found"))
    joined = rows.join(known, "digest", "left")
    return joined.select(F.col("id").alias(id_col), "digest", "license", F.size("found").cast("long").alias("n_notice_lines"), F.array_sort(F.array_distinct("found")).alias("notices"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"), known_licenses(spark))
    return found.select("doc_id", "digest", F.coalesce("license", F.lit("")).alias("license"), "n_notice_lines", F.array_join("notices", ",").alias("notices"))


def _canonical_sql(x: str) -> str:
    pairs = ", ".join(f"'{k}'" for k in SPELLINGS), ", ".join(f"'{v}'" for v in SPELLINGS.values())
    plain = rf"trim(regexp_replace(regexp_replace(lower({x}), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright\b|\(c\)|©)[^\n]*$', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(map([{pairs[0]}], [{pairs[1]}])[w], w)), ' ')"


def _sql() -> str:
    def values(of: dict[str, str]) -> str:
        return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in of.items())

    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (
  SELECT sha256({_canonical_sql("t")}) AS digest, license FROM (VALUES {values(KNOWN)}) v(license, t)
  UNION ALL SELECT digest, license FROM (VALUES {values(KNOWN_DIGESTS)}) v(license, digest)) GROUP BY 1),
n AS (SELECT {_canonical_sql("t")} AS line, name FROM (VALUES {values(NOTICES)}) v(name, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN text IS NOT NULL THEN sha256({_canonical_sql("text")}) END AS digest FROM documents),
l AS (SELECT r, {_canonical_sql("line")} AS line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> ''),
f AS (SELECT r, count(*) AS c, string_agg(DISTINCT name, ',' ORDER BY name) AS of FROM l JOIN n USING (line) GROUP BY r)
SELECT doc_id, d.digest, coalesce(k.license, '') AS license, CAST(coalesce(c, 0) AS BIGINT) AS n_notice_lines, coalesce(of, '') AS notices
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN f USING (r)
"""


SQL = {"op7_license_scan": _sql()}
QUERIES = {"op7_license_scan": op7_license_scan}


if __name__ == "__main__":
    import sys
    from pathlib import Path

    files = sorted(p for p in Path(sys.argv[1]).iterdir() if p.is_file() and not p.is_symlink())
    session = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    for row in session.createDataFrame([(p.name, p.read_text()) for p in files], "name string, text string").select("name", digest(F.col("text")).alias("digest")).collect():
        print(f'    "{row["name"]}": "{row["digest"]}",')
