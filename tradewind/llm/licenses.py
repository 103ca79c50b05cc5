"""Licence texts recognised by the digest of their canonical form.

Canonical form: small letters; lines of copyright notices and of rights reserved
dropped; equivalent spellings and quotation marks made one; list marks and
comment marks at the start of lines dropped; everything but letters and digits
is a single space. The SHA-256 of the canonical form of an entire text is joined
with the digests of known texts. DataFrame functions only.

Defined cases: a null text has no digest and no licence; a text that is empty in
canonical form has no licence; rows with null or repeated ids are answered row by
row; two known texts of one digest give the least name. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of public licences, and short notices in use.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_MIT = f"""{_MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

{_MIT_WARRANTY}"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = f"""{_BSD_2}

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = {
    "MIT": (f"MIT License\n\n{_MIT}", f"The MIT License (MIT)\n\n{_MIT}", f"The MIT License\n\n{_MIT}", _MIT),
    "MIT-0": (f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_WARRANTY}", f"{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    "BSD-2-Clause": (f"BSD 2-Clause License\n\n{_BSD_2}\n\n{_BSD_WARRANTY}", f"{_BSD_2}\n\n{_BSD_WARRANTY}"),
    "BSD-3-Clause": (f"BSD 3-Clause License\n\n{_BSD_3}\n\n{_BSD_WARRANTY}", f"{_BSD_3}\n\n{_BSD_WARRANTY}"),
    "ISC": (
        f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
        f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    ),
    "0BSD": (f"BSD Zero Clause License\n\n{_GRANT}.\n\n{_ISC_WARRANTY}", f"Zero-Clause BSD\n\n{_GRANT}.\n\n{_ISC_WARRANTY}", f"{_GRANT}.\n\n{_ISC_WARRANTY}"),
    "Zlib": (f"zlib License\n\n{_ZLIB}", _ZLIB),
    "notice:Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "notice:CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "notice:GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "notice:MIT": ("Released under the MIT License.",),
}
#: Spellings taken as equal: each of the first is read as the second.
SPELLINGS = (
    (r"copyright owner", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"analogue", "analog"),
    (r"authorisation", "authorization"),
    (r"licence", "license"),
    (r"sub-license|sub license", "sublicense"),
    (r"merchantibility", "merchantability"),
    (r"non-infringement|non infringement", "noninfringement"),
    (r"per cent", "percent"),
    (r"https?:", ""),
)
#: What is replaced in a text of small letters, in this order.
REWRITES = (
    (r"(?m)^[\t *#/;>-]*(copyright( \(c\)| ©| [0-9])|\(c\) |©|all rights reserved)[^\n]*$", ""),
    (r"(?m)^[\t ]*(([0-9]{1,2}|[a-z])[.)]|\([0-9a-z]{1,2}\)|[*#/;>-]+)[\t ]+", ""),
    *SPELLINGS,
    (r"[^\p{L}\p{N}]+", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(text)
    for pattern, by in REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def known(spark: SparkSession, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """license and digest of known texts."""
    rows = [("", "")] + [(name, text) for name, forms in (KNOWN if texts is None else texts).items() for text in forms]
    literals = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in rows))
    frame = spark.range(1).select(F.explode(literals).alias("known")).select("known.*")
    form = canonical(F.col("text"))
    return frame.where(form != "").groupBy(F.sha2(form, 256).alias("known_digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, digest and license (null if unknown) of each row of docs.
    The known texts are a parameter of the call: their table is as long as that."""
    form = canonical(F.col("text"))
    hashed = docs.select(F.col("doc_id").cast("long"), F.sha2(form, 256).alias("digest"))
    return hashed.join(F.broadcast(known(docs.sparkSession, texts)), F.col("digest") == F.col("known_digest"), "left").select(
        "doc_id", "digest", "license"
    )
