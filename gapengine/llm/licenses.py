"""Licence scans: canonical digests of entire texts, joined by hash with those of known licences.

A canonical text is lower-case, without copyright notices, punctuation and layout, with equivalent spellings made one; its SHA-256 is
joined with a table of known digests. Lines that speak of a licence are looked up as texts of their own, which finds short notices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.llm import common as c

#: Spellings that licence matching guidelines hold equivalent.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Public licence texts, (id, text). Callers may pass a table of their own; notices() are added to it.
KNOWN = (
    ("MIT", _MIT), ("MIT", f"MIT License\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("0BSD", f"{_ISC}.\n{_ISC_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}"),
)
#: Licence identifiers and the names that notices give them.
NAMES = {
    "0BSD": ["BSD Zero Clause License"], "AGPL-3.0": ["GNU Affero General Public License, version 3"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSL-1.0": ["Boost Software License 1.0"], "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "EPL-2.0": ["Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"], "GPL-2.0": ["GNU General Public License, version 2"], "GPL-3.0": ["GNU General Public License, version 3"], "ISC": ["ISC License"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "MIT": ["MIT License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"], "ODbL-1.0": ["Open Database License 1.0"], "OFL-1.1": ["SIL Open Font License 1.1"],
    "Unlicense": ["Unlicense"], "Zlib": ["zlib License"],
}
SAYINGS = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.")


def notices() -> list[tuple[str, str]]:
    """(id, notice): the identifier lines and the sayings of each name."""
    own = [(k, f"SPDX-License-Identifier: {k}{tail}") for k in NAMES for tail in (("", "-only", "-or-later") if "GPL" in k else ("",))]
    return own + [(k, saying.format(name)) for k, names in NAMES.items() for name in names for saying in SAYINGS]


def texts_in(folder: str) -> list[tuple[str, str]]:
    """(id, text) of a local folder of whole licence texts, whose files are named by their ids: to be added to KNOWN."""
    return [(f.stem if f.suffix == ".txt" else f.name, f.read_text(errors="replace")) for f in sorted(Path(folder).iterdir()) if f.is_file()]


#: Digests that are broadcast, 100 bytes each.
SMALL = 100_000
_MARK = rb"(?:copyright(?:[\s:,]*(?:\(c\)|\xc2\xa9))?|copr\.(?:\s*\(c\))?|\(c\)(?:\s*copyright)?|\xc2\xa9(?:\s*copyright)?)"
_YEAR = rb"(?:19|20)\d\d"
#: Words that follow "copyright" where a text only speaks of it.
_SPOKEN = rb"(?:notices?|holders?|owners?|laws?|licen[sc]\w*|statements?|and|or|in|of|on|to|is|are|by the|interests?|protection|acts?|infringe\w*|disclaimers?|terms?|information|headers?|as|for|with|that|which|restrictions?|claims?)\b"
#: A notice ends with its line, with its sentence (not at an initial) and before words that a licence begins with.
_REST = rb"(?:(?!\n|\b(?:permission (?:is|to)|redistribution and|released under|licensed under|spdx-license|(?:the )?(?:mit|isc|0?bsd|apache) licen[sc]e|all rights reserved|this (?:work|software|program|file|source)|the software)\b|(?<=[^\W_][\w)>\x22'])\.\s+(?!and\b|or\b|&))[\s\S])*\.?"
_COPYRIGHT = re.compile(
    rb"(?m)(?<![a-z0-9])(?:" + _YEAR + rb"[\s,-]+)?" + _MARK + rb"[\s:,]*(?=" + _YEAR + rb")" + _REST  # with a year: anywhere
    + rb"|(?<![a-z0-9])(?:copyright[\s:,]*(?:\(c\)|\xc2\xa9)|\xc2\xa9)[ \t:,]*(?=[a-z<\[{\x80-\xff])" + _REST  # with a sign and a holder: anywhere
    + rb"|^[^a-z\n]*\(c\)[ \t]+(?=[^\n.;]{1,60}\b" + _YEAR + rb")" + _REST
    + rb"|(?:^[^a-z\n]*|(?<=\.) +)(?:copyright|copr\.)[ \t:,]+(?!" + _SPOKEN + rb")(?=[a-z<\[{\x80-\xff])" + _REST  # a holder alone: where a line or sentence begins
    + rb"|\ball\s+rights\s+reserved\b\.?"
)
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_PARTS = {k.encode(): v.encode() for k, v in EQUIVALENT.items()}


def canonical(text: bytes | None) -> bytes:
    """The canonical form: words between single spaces. Null and texts without a letter or digit give an empty one."""
    if not text:
        return b""
    low = text.lower()
    if b"copyright" in low or b"(c)" in low or b"\xc2\xa9" in low or b"copr." in low or b"rights" in low:
        low = _COPYRIGHT.sub(b"", low)
    low = low.replace(b"\xe2\x80\x9c", b" ").replace(b"\xe2\x80\x9d", b" ").replace(b"\xe2\x80\x98", b" ").replace(b"\xe2\x80\x99", b" ").replace(b"\xe2\x80\x93", b" ").replace(b"\xe2\x80\x94", b" ")
    tokens = low.translate(_KEEP).split()
    return b" ".join([_PARTS.get(w, w) for w in tokens])


def digest(text: bytes | None) -> str | None:
    form = canonical(text)
    return hashlib.sha256(form).hexdigest() if form else None


def known_digests(known=None) -> dict[str, str]:
    """Digest to id; of equal digests the first id counts. None: KNOWN and notices()."""
    out: dict[str, str] = {}
    for name, text in (*KNOWN, *notices()) if known is None else known:
        if d := digest(text.encode()):
            out.setdefault(d, name)
    return out


def notice_digests(text: bytes | None) -> list[str]:
    """The distinct digests of the lines that speak of a licence, in any case."""
    if not text or b"licen" not in (low := text.lower()):
        return []
    return sorted({d for line in low.split(b"\n") if b"licen" in line and (d := digest(line))})


def scanned(docs: DataFrame, known=None, small: int = SMALL) -> DataFrame:
    """(doc_id, digest, license_id, notices) of each document: its canonical digest, the licence whose whole text it is, and the licences of its notice lines.

    Null, empty and wordless texts have a null digest and no licence; notices is sorted, distinct and may be empty. Repeated rows all stay; an empty table gives no rows. Other columns are ignored.
    A text of any length is one task's string, several times over in memory. known is a list of the caller's; up to small digests are broadcast, to tasks and joins alike, more are joined by a shuffle, whole texts and notices.
    """
    lines = known_digests(known)
    few = lines if len(lines) <= small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = c.raw(b)
            for i, j in c.chunks(texts):
                found = [digest(t) for t in texts[i:j]]
                told = [notice_digests(t) for t in texts[i:j]]
                if few is not None:
                    told = [sorted({few[d] for d in own if d in few}) for own in told]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(found, pa.string()), pa.array(told, pa.list_(pa.string()))], ["doc_id", "digest", "notices"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(c.lean(run), "doc_id long, digest string, notices array<string>")
    table = docs.sparkSession.createDataFrame(sorted(lines.items()) or [("", "")], "digest string, license_id string")
    if few is not None:
        table = F.broadcast(table)
    else:
        told = c.written(told.withColumn("row", F.monotonically_increasing_id()), "told")
        named = told.select("row", F.explode("notices").alias("digest")).join(table, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("names"))  # a row's own notices
        told = told.join(named, "row", "left").select("doc_id", "digest", F.coalesce("names", F.array().cast("array<string>")).alias("notices"))
    # wordless texts have no digest: kept apart, else they would all meet in one task
    found = told.where("digest is not null").join(table, "digest", "left")
    return found.unionByName(told.where("digest is null").withColumn("license_id", F.lit(None).cast("string")), allowMissingColumns=True).select("doc_id", "digest", "license_id", "notices")
