"""License scans by canonical digests, with DataFrame functions only.

A text unit (a run of consecutive lines: one line, a paragraph, several, or the whole document) is brought to a
canonical form: lower case, without copyright and title lines, equivalent spellings alike, punctuation and white space
as single spaces. The digest of the entire unit is then joined to the digests of known license texts and notices, a
constant table. Of all runs only those with the length of a known text are looked up, found from the places of line
ends. Only texts that hold a string which some known text needs are brought to that form at all.
"""

from __future__ import annotations

import re
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("authorise", "authorize"),
    ("recognise", "recognize"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non-infringement"),
    ("per cent", "percent"),
    ("https://", "http://"),
    ("copyright holder", "copyright owner"),
    ("&", " and "),
]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|©|\(c\)[ \t]*[0-9]{4})[^\n]*$"
TITLE_LINE = r"(?m)^[^\p{L}\p{N}\n]*((the )?(mit|isc|zlib|bsd [23]-clause|bsd zero clause) license( \(mit\))?|all rights reserved)[^\p{L}\p{N}\n]*$"
OTHER_SIGNS = r"[^\p{L}\p{N}\n]+"

#: Known license texts and notices.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def by_lines(text: Column) -> Column:
    """Canonical form that still has its line ends."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\r\n?", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, COPYRIGHT_LINE, ""), TITLE_LINE, "")
    plain = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)
    return F.regexp_replace(plain, OTHER_SIGNS, " ")


def joined(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """license_id, canonical body and its digest; one row per distinct body."""
    rows = F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("body")) for a, b in texts))
    table = spark.range(1).select(F.inline(rows)).withColumn("body", joined(by_lines(F.col("body")))).where("body != ''")
    return table.groupBy("body").agg(F.min("license_id").alias("license_id")).withColumn("digest", F.sha2("body", 256))


def probe(body: str) -> str:
    """A string that every lower-cased text with this canonical unit holds, however its words are spelled."""
    best = ""
    for word in body.split():
        for source, target in SPELLINGS:
            sources, targets = (re.findall(r"[a-z0-9]+", x) for x in (source, target))
            for part in set(targets) - set(sources):
                if part in word:
                    word = word[: word.index(part) + max((len(commonprefix([part, x])) for x in sources), default=0)]
        best = max(best, word, key=len)
    return best


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Known licenses in ``docs`` (doc_id, text; other columns are ignored).

    ``texts`` are (license_id, text) pairs, few enough for the driver; KNOWN if not given. A null or empty text
    holds none; texts of any length are taken whole; an empty table gives none. Of licenses with one canonical text the
    first name stands. Repeated rows add up, null ids are one document. Result, one row per document and license that
    is found: doc_id, license_id, n_units (distinct runs of lines that are the license), whole_text (the document is nothing else).
    """
    table = known(docs.sparkSession, KNOWN if texts is None else texts)
    bodies = [r.body for r in table.select("body").collect()]  # as many as ``texts`` at most
    probes = sorted({probe(x) for x in bodies})
    likely = reduce(lambda x, y: x | y, (F.contains(F.lower(F.col("text").cast("string")), F.lit(x)) for x in probes), F.lit(False))
    lengths = sorted({len(x) for x in bodies})
    body = docs.where(likely).select("doc_id", by_lines(F.col("text")).alias("body")).withColumn("whole", joined(F.col("body")))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # places in ``whole`` where lines begin, and one past its end: each line's length and a space further
    places = F.aggregate(lines, F.array(F.lit(0)), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + F.length(x) + 1)))
    runs = lambda n: F.transform(F.array_intersect(F.transform("places", lambda p: p + F.lit(n + 1)), F.col("places")), lambda end: F.substr(F.col("whole"), end - n, F.lit(n)))
    units = body.withColumn("places", places).select("doc_id", "whole", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("unit"))
    hits = units.withColumn("digest", F.sha2("unit", 256)).join(F.broadcast(table.drop("body")), "digest")  # bounded as above
    return hits.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_units"), F.max(F.col("unit") == F.col("whole")).alias("whole_text"))
