"""License scan by canonical digests.

A text's lines are brought to a canonical form: lower case, one space for all
that is neither letter nor digit, one spelling for equivalent words. Lines of
copyright are left out, the rest is joined, and the digest of the whole is
looked up by a hash join among the digests of known licences and notices. The
same join looks up each line by itself, as notices stand inside other text.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that count as one, as in the SPDX matching guidelines.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright holder": "copyright owner",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "v": "version",
    "whilst": "while",
    "wilful": "wilfull",
}

#: Names by which notices call licences.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL, version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL, version 3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL, version 3"],
    "MIT": ["MIT License", "Expat License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License"],
}

#: Phrases around a name.
NOTICES = [
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "Available under {}.",
    "This work is licensed under {}.",
    "This project is licensed under {}.",
    "This program is licensed under {}.",
    "This software is released under {}.",
]

#: Whole licence texts without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}

#: The notices that the longer licences ask for at the head of a file.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: Digests of the canonical form of whole official texts that are too long to stand here.
WHOLE = {
    "Apache-2.0": "b41b69f0dea0598ca720f95f7c676dc79782779377951993e5bdd566fec422f3",
    "Artistic-1.0": "c6aebc79b70bfe6e6f1b9f8922db9a6e5427be3d7a3d18f91f97535efb97d614",
    "CC0-1.0": "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3",
    "GFDL-1.2": "972be281081c29947d0bdf661acb7130e4dd0d2a9a142f2c39e263c2e0c4ca20",
    "GFDL-1.3": "be8ed4c290826d53c03cb156846cfdd4a30efc49ea81bb7ffa5bee025939cd0d",
    "GPL-1.0": "179b24a3b847bc456dc9e24dec488fcf78bfd5ee810b7bb21f6a280feeb85d37",
    "GPL-2.0": "9405dc2ae3fe08dea519d5874a1a44bb05d513336aed49976b5030bd5b8f27f6",
    "GPL-3.0": "5b25941b7ce14bec86a18281117c7eb444424cebd6485a2be21bd82a6b161f4e",
    "LGPL-2.0": "6d450d1ebaa20ebfaf4db3349aea4f6d20fed294c7a11fa809c0934df11790aa",
    "LGPL-2.1": "c50d1dab612965648634f79bbc0a4de520f387ff588eaccddc9a4989710ed9d0",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead",
}

#: A canonical line that only says whose copyright it is.
COPYRIGHT = r"^(c )?(copyright|copr|all rights reserved)( |$)"


def known() -> list[tuple[str, str]]:
    """``(license, text)`` of all known texts; titles and notices are made from the names."""
    out = [*TEXTS.items(), *HEADERS.items()]
    for key, text in TEXTS.items():
        first, _, rest = text.partition("\n\n")
        body = rest if len(first) < 40 else text  # a title that some copies leave out or spell otherwise
        titles = ["", *(t for name in NAMES[key] for t in (name, f"The {name}", f"{name} ({key})", f"The {name} ({key})"))]
        out += [(key, f"{t}\n\n{body}") for t in titles]
    for key, names in NAMES.items():
        out += [(key, f"SPDX-License-Identifier: {key}")]
        for name in names:
            out += [(key, notice.format(article + name)) for notice in NOTICES for article in ("", "the ")]
    return out


#: Words by themselves, and what is two words.
SINGLE = {a: b for a, b in EQUIVALENT.items() if " " not in a}
PAIRS = {a: b for a, b in EQUIVALENT.items() if " " in a}


def canonical_line(text: str) -> str:
    """Canonical form of one line; '' for a line of copyright. A canonical line is its own form."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    line = " ".join(SINGLE.get(w, w) for w in "".join(c if c.isalnum() else " " for c in low).split(" ") if w)
    # Each word has its own spaces, so that neighbours don't share one.
    padded = f" {line.replace(' ', '  ')} "
    for a, b in PAIRS.items():
        padded = padded.replace(f" {a.replace(' ', '  ')} ", f" {b} ")
    line = re.sub(" +", " ", padded).strip(" ")
    return "" if re.search(COPYRIGHT, line) else line


def digest(text: str) -> str:
    lines = [x for x in map(canonical_line, re.split("[\r\n]+", text)) if x]
    return hashlib.sha256(" ".join(lines).encode()).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    """``(digest, license)``, one row a digest."""
    return sorted(({d: key for key, d in WHOLE.items()} | {digest(text): key for key, text in known()}).items())


def canonical_lines(text: Column) -> Column:
    """Canonical, non-empty lines of a text column."""
    low = F.translate(text, UPPER, LOWER)

    single = F.create_map(*(F.lit(x) for pair in SINGLE.items() for x in pair))

    def line(x: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
        padded = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.coalesce(single[w], w)), "  "), F.lit(" "))
        for a, b in PAIRS.items():
            padded = F.replace(padded, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
        return F.trim(F.regexp_replace(padded, " +", " "))

    return F.filter(F.transform(F.split(low, "[\r\n]+"), line), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``(doc_id, digest, license, notices, n_notices)``, one row per input row.

    ``license`` is that of the whole text, null if unknown; ``notices`` are the
    licences of single lines, each once, sorted and comma-joined; ``n_notices``
    counts such lines. ``texts`` (license, text) are known, too, but for
    those without words; of several licences with one text the first by name counts. A null text is empty, a
    very long one is read whole. Rows that repeat a doc_id with the same text
    are alike; rows without an id are looked up, too. Other columns aren't
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known_digests(), "known string, license string")
    if texts is None:  # as many rows as the fixed values above give, whatever the corpus
        table = F.broadcast(table)
    else:
        own = texts.select(F.sha2(F.array_join(canonical_lines(F.coalesce("text", F.lit(""))), " "), 256).alias("known"), "license")
        table = table.unionByName(own.where((F.col("license").isNotNull()) & (F.col("known") != hashlib.sha256().hexdigest()))).groupBy("known").agg(F.min("license").alias("license"))
    units = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
        .select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(F.array_join("lines", " "), 256).alias("digest"), "lines")
        .select("doc_id", "row", "digest", F.explode_outer(F.transform("lines", lambda x: F.sha2(x, 256))).alias("known"))
    )
    # A row's lines are in one partition, so their partial sums are one record.
    notices = units.join(table, "known", "left").groupBy("row", "doc_id", "digest").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("license").alias("n_notices")
    )
    whole = table.withColumnRenamed("known", "digest")
    return notices.join(whole, "digest", "left").select("doc_id", "digest", "license", "notices", "n_notices")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    padded = r"regexp_replace(' ' || x || ' ', '[^\p{L}\p{N}]+', '  ', 'g')"
    padded = reduce(lambda s, p: f"replace({s}, ' {p[0].replace(' ', '  ')} ', ' {p[1]} ')", [*SINGLE.items(), *PAIRS.items()], padded)
    padded = f"regexp_replace({padded}, ' +', ' ', 'g')"
    values = ", ".join(f"('{d}', '{k}')" for d, k in known_digests())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
lined AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\r\\n]+'),
    lambda x: trim({padded}, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}')) AS lines
  FROM documents),
units AS (SELECT doc_id, sha256(coalesce(array_to_string(lines, ' '), '')) AS digest, lines FROM lined),
hits AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM (SELECT doc_id, sha256(unnest(lines)) AS line FROM units) JOIN known ON line = digest GROUP BY doc_id)
SELECT u.doc_id, u.digest, k.license, coalesce(h.notices, '') AS notices, coalesce(h.n, 0)::BIGINT AS n_notices
FROM units u LEFT JOIN known k USING (digest) LEFT JOIN hits h USING (doc_id)"""
