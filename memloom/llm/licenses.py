"""License scans by canonical digests, in DataFrame functions only.

A whole text is normalised (case, lines of copyright, spelling variants, punctuation and blanks) and
its SHA-256 is looked up among the digests of known licences, which go through the same expressions.
A text that is not found is looked up once more in a second form, from which only the notices themselves
(mark, year and owner) are taken instead of whole lines, so that line breaks do not matter; there
each licence is known with and without its titles, and long licences by their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that hold an owner or a year, not terms.
COPYRIGHT_LINE = r"(?m)^[^a-z\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Equivalent spellings, as (from, to); both sides of the lookup are rewritten, in this order.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("labour", "labor"),
    ("behaviour", "behavior"), ("honour", "honor"), ("fulfilment", "fulfillment"), ("isation", "ization"),
    ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"), ("initialis", "initializ"),
    ("utilis", "utiliz"), ("programme", "program"), ("whilst", "while"), ("offence", "offense"), ("artefact", "artifact"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"),
)
BLANKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Known licences beyond this many rows are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Public licence texts and notices, by identifier (fixed values).
KNOWN = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS,
    "ISC": f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"Zero-Clause BSD\n{_ISC}.\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}\n{_BSD_3}\n{_BSD_END}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = "For more information, please refer to <http://unlicense.org/>"
#: Texts without their title, and the titles that they are known with.
TITLED = {
    "MIT": (KNOWN["MIT"].split("\n", 1)[1], ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License")),
    "ISC": (KNOWN["ISC"].split("\n", 1)[1], ("ISC License", "The ISC License", "ISC License (ISC)")),
    "0BSD": (KNOWN["0BSD"].split("\n", 1)[1], ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License (0BSD)", "0BSD")),
    "BSD-2-Clause": (KNOWN["BSD-2-Clause"], ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License")),
    "BSD-3-Clause": (KNOWN["BSD-3-Clause"], ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License")),
    "Zlib": (KNOWN["Zlib"], ("zlib License", "The zlib License", "zlib/libpng License")),
    "Unlicense": (_UNLICENSE, ("The Unlicense", "Unlicense")),
}
#: Second-form digests of long licences, whole and up to the end of their terms.
DIGESTS = {
    "451f843db4430d3e5a2048e68be5513079ee7a716d903053b757264202a7b2a3": "Apache-2.0",
    "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64": "Apache-2.0",
    "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "cbdccc39d3921ad822df3db3f1e1e240d95e9475f5314b13409b57abde669960": "GPL-1.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "9446e90729c87bfcb99cac9c416311543826b8e4fcb49ab618db8533715c22e2": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "7010be23a914878c7423eb72d05d1c165d0e6d321e54113670fe530b842b74a8": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d": "LGPL-2.0",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "d8d0b06e50958b0eba5a23fe34f89208823600494dec35f53d75d38796963973": "MPL-1.1",
    "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d": "MPL-2.0",
}
#: The mark or the word with a year or a mark after it; then the owner, up to the line's end or to where terms begin.
NOTICE = (
    r"(?:copyright[ \t:]*(?:\(c\)|©|[\[<{]?(?:yyyy|year|[0-9]{4}))|\(c\)[ \t]*[\[<{]?(?:yyyy|year|[0-9]{4})|©)[^\n]{0,200}?"
    r"(?=\n|$|all rights reserved|permission is hereby granted|permission to use, copy|redistribution and use|this software is provided"
    r"|everyone is permitted|this (?:program|library) is free|this is free and unencumbered|licensed under|copyright|©|\(c\))"
)
#: Every known text holds one of these, so only texts with one need the second form.
WORDS = r"licen[sc]e|software"


def notices_out(text: Column) -> Column:
    """The second form: like ``canonical``, but only notices go and no other part of their lines."""
    x = F.regexp_replace(F.lower(text), NOTICE, " ")
    return _unified(F.regexp_replace(x, r"all\s+rights\s+reserved", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, bare_sha256) of the built-in licences in the second form."""
    texts = [(k, v) for k, v in KNOWN.items()]
    for k, (body, titles) in TITLED.items():
        bodies = (body, f"{body}\n{_MORE}") if k == "Unlicense" else (body,)
        texts += [(k, f"{t}\n{b}") for b in bodies for t in ("", *titles)]
    named = spark.createDataFrame(texts, "license_id string, text string").select("license_id", F.sha2(notices_out(F.col("text")), 256).alias("bare_sha256"))
    if not DIGESTS:
        return named
    return named.unionByName(spark.createDataFrame([(k, d) for d, k in DIGESTS.items()], "license_id string, bare_sha256 string"))


def canonical(text: Column) -> Column:
    """Lower case; copyright lines out; spellings unified; other marks and blanks as single spaces."""
    return _unified(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""))


def _unified(x: Column) -> Column:
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, BLANKS, " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in licences."""
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def license_scan(
    docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None
) -> DataFrame:
    """One row per document: id, canonical_sha256, license_id (null: no known licence).

    Null text has a null digest and no licence; texts without letters or digits have the digest of the
    empty text and no licence. Of licences with equal digests the least id is told. Repeated rows stay;
    an empty table, or no known licences, is fine; other columns are not read. ``digests``
    (license_id, bare_sha256) are looked up by the second form for texts that the first does not find.
    """
    digest = F.sha2(canonical(F.col(text_col)), 256)
    known = (
        licenses.where(canonical(F.col("text")) != "")
        .groupBy(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
        .agg(F.min("license_id").alias("license_id"))
    )
    if known.count() <= BROADCAST_ROWS:  # 100 bytes a row
        known = F.broadcast(known)
    text = F.col(text_col)
    bare = F.when(F.lower(text).rlike(WORDS), F.sha2(notices_out(text), 256)) if digests is not None else F.lit(None).cast("string")
    found = docs.select(F.col(id_col), digest.alias("canonical_sha256"), bare.alias("bare_sha256")).join(known, "canonical_sha256", "left")
    if digests is not None:
        more = digests.groupBy("bare_sha256").agg(F.min("license_id").alias("bare_id"))
        more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
        found = found.join(more, "bare_sha256", "left").withColumn("license_id", F.coalesce("license_id", "bare_id"))
    return found.select(id_col, "canonical_sha256", "license_id")
