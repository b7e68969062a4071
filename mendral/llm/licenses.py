r"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case; lines that state a copyright
dropped; equivalent spellings made one; everything between ASCII letters, digits
and non-ASCII characters one space) and hashed. Entire texts are joined by hash
to the digests of known licences. Lines that may state a licence are made
canonical as well and looked up among known one-line notices, as a licence is
often only named.

Defined results: null and empty texts have the digest of the empty string, no
licence and no notices. Ids are passed on, null or repeated. Other columns are
never read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

COPYRIGHT_LINE = r"(?m)^[ \t#*/;%>-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
# fixed values: spellings that licence matching guidelines treat as the same
EQUIVALENT = (
    ("licence", "license"),
    ("licensor's", "licensors"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("noncommercial", "non-commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright holder", "copyright owner"),
    ("http://", "https://"),
    ("&", " and "),
)
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
QUOTES = str.maketrans({c: "'" for c in "‘’“”«»"} | {c: "-" for c in "‐‑‒–—"})


def canonical(text: str | None) -> str:
    """The canonical form in Python, for the registry."""
    x = (text or "").translate(QUOTES)
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    x = re.sub(COPYRIGHT_LINE, "", x)
    for a, b in EQUIVALENT:
        x = x.replace(a, b)
    return re.sub(SEPARATORS, " ", x).strip(" ")


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def prepared(text: Column) -> Column:
    """Lower case A-Z and plain quotes, lines kept."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(text, F.lit("")), upper + "‘’“”«»‐‑‒–—", lower + "''''''-----")


def flattened(x: Column) -> Column:
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, SEPARATORS, " "))


_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Whole texts of known licences; a title line is optional.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", _MIT_GRANT, _MIT_DISCLAIMER),
    "ISC": ("ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", _ISC_DISCLAIMER),
    "0BSD": ("BSD Zero Clause License", f"{_ISC_GRANT}.", _ISC_DISCLAIMER),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD_HEAD, _BSD_DISCLAIMER),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD_HEAD, _BSD_THIRD, _BSD_DISCLAIMER),
    "Apache-2.0": ("", _APACHE_HEADER),
    "Zlib": ("zlib License", _ZLIB),
}
#: Digests of complete licences as published (no text of theirs is kept here): all of it and,
#: where it has an appendix after "END OF TERMS AND CONDITIONS", up to that line with and without it.
COMPLETE: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("cc411e5c73676ae13e68bf0fe2c031a62b3a1ef56829577a7d168699686c1e7e", "bb9623a3f15021216105e0ed4e2426d8ef8863d7c5f58860ef1cd2bf983015cf", "f16a2c71cdef52763eb4e8d07430ba72c05356a4e2204a12f3995c1ee5d38fde"),
    "GPL-1.0": ("563aa819aa634f9698b263e285a0ef92b5388d22a13d9d829e3fd461737efbed", "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70", "3c796b04cfbd58d45e505bbfd656f39ed02b0e66f4b7768a6c92eb29931304c8"),
    "GPL-2.0": ("4bd5045a48706fa5e862541daebbb8131a7a8a1bcc2af75687a0be635a07350d", "e77ea949ae7126e628ca6a81f53dc5a46e37445a68a69a45ea7fabfbe24b9e7b", "f413c75f54266e62e9f744800f8a3439c3842cc39c4fa37dd3fbda1a51095baf"),
    "GPL-3.0": ("f6d8b65199511fd46ea7fac53d0f8e5331927ab2b76ee90e14b8c6d0d77713bd", "3b36e75d612e42ddf64d6a73bfee647eb1f7f6ee1e61f4bba56921a15c85cc4c", "3c74c1255fee4531c1360ca5790c9d5219824373959ee687ca01e08670eff78d"),
    "LGPL-2.0": ("2497dd9192c415f9e6962fa2bef333b5f1bbee1f12bbcce9a65e69779dbd2d1c", "c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a", "3bb3f2f987ac797968f7655d8946e3fb45c8ed8e489b8090b8c2957416070991"),
    "LGPL-2.1": ("d786ddfefca9502d2e51ecd68e214dec39d11c7ae4ad98fea161729f900888d2", "0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e", "14d2766e74523a520125045c7df201c048aea2169d95faf662634c49a477ae7d"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",),
    "MPL-2.0": ("3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("3e904b03071187235d313f918c60be524121c718ca44346862ed3beb1bb46296",),
    "GFDL-1.3": ("974278ae87f95c1e29f3876f9ad2d44bb5dd7e8887e7726bf9c2e7fb121308b8",),
}
#: Names by which a one-line notice may call a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0"),
    **{f"GPL-{v}.0": (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GNU GPL v{v}", f"GPL-{v}.0") for v in (1, 2, 3)},
    **{f"LGPL-{v}": (f"GNU Lesser General Public License, version {v}", f"LGPL-{v}") for v in ("2.1", "3.0")},
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "Creative Commons Zero 1.0"),
}
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This file is licensed under", "This software is licensed under", "This work is released under", "SPDX-License-Identifier:", "License:")
#: What a line must contain, canonical or not, to be looked up.
HINT = r"licens|licenc|released under|distributed under|published under|available under"


def license_digests() -> dict[str, str]:
    out = {}
    for name, (title, *body) in TEXTS.items():
        for parts in (body, [title, *body]):
            out[digest("\n\n".join(parts))] = name
    for name, known in COMPLETE.items():
        out |= dict.fromkeys(known, name)
    return out


def notice_digests() -> dict[str, str]:
    return {digest(f"{opening} {the}{called}"): name for name, names in NAMES.items() for called in names for opening in OPENINGS for the in ("", "the ")}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id (whole text), notices (named in lines, sorted) of every row."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(license_digests().items()), "canonical_sha256 string, license_id string"))  # up to four rows for each licence
    notices = F.create_map(*[F.lit(x) for kv in sorted(notice_digests().items()) for x in kv])
    rows = docs.select("doc_id", prepared(F.col("text")).alias("x"))
    lines = F.filter(F.split("x", "\n"), lambda line: line.rlike(HINT))
    named = F.when(F.col("x").rlike(HINT), F.transform(lines, lambda line: F.sha2(flattened(line), 256))).otherwise(F.array().cast("array<string>"))
    hashed = rows.select("doc_id", F.sha2(flattened(F.regexp_replace("x", COPYRIGHT_LINE, "")), 256).alias("canonical_sha256"), named.alias("d"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform("d", lambda d: F.try_element_at(notices, d)), lambda n: n.isNotNull())))
    return hashed.join(known, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id", F.array_join(found, ",").alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def flat(x: str) -> str:
        for a, b in EQUIVALENT:
            x = f"replace({x}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({x}, {quoted(SEPARATORS)}, ' ', 'g'), ' ')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”«»‐‑‒–—", "abcdefghijklmnopqrstuvwxyz''''''-----"
    values = lambda d: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(d.items()))
    return f"""
WITH known(canonical_sha256, license_id) AS (VALUES {values(license_digests())}),
notice(d, name) AS (VALUES {values(notice_digests())}),
t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {quoted(upper)}, {quoted(lower)}) AS x FROM documents),
h AS (SELECT r, doc_id, sha256({flat(f"regexp_replace(x, {quoted(COPYRIGHT_LINE)}, '', 'g')")}) AS canonical_sha256 FROM t),
l AS (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t WHERE regexp_matches(x, {quoted(HINT)})),
n AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT r, sha256({flat("line")}) AS d FROM l WHERE regexp_matches(line, {quoted(HINT)})) JOIN notice USING (d) GROUP BY r)
SELECT doc_id, canonical_sha256, license_id, coalesce(names, '') AS notices FROM h LEFT JOIN known USING (canonical_sha256) LEFT JOIN n USING (r)
"""


ORACLE = _oracle()
