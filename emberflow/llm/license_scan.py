"""Licence scan by canonical digests.

A text's canonical form is lower-cased, without copyright lines, with equivalent spellings made one and
everything but letters and digits turned into single spaces, so it doesn't depend on case, punctuation,
layout or line breaks. Its SHA-256 is hash-joined to the digests of known licences and notices. Lines are
canonical by themselves, so a notice that stands on a line of its own inside a text is found as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, fresh, table
from emberflow.llm.textkit import slices

# Spellings that licence matching treats as equivalent.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "http": "https", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "percent": "per cent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
    "non infringement": "noninfringement", "noncommercially": "non commercially",
}

# Public licence texts and their usual one-line notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BY_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "MIT": f"""MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_NO_WARRANTY}""",
    "ISC": f"""ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_AS_IS}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_AS_IS}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT-0": f"""MIT No Attribution

Copyright <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

{_NO_WARRANTY}""",
    "BSD-2-Clause": f"""Copyright (c) <year>, <copyright holders>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{_BY_HOLDERS}""",
    "BSD-3-Clause": f"""Copyright (c) <year>, <copyright holders>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_BY_HOLDERS}""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}

_COPYRIGHT = re.compile(r"^[^\w(©]*(?:portions\s+)?(?:copyright\b(?=\W*(?:\(c\)|©|\d|<|by\b|\[))|\(c\)|©|all rights reserved\b)")
_REST = re.compile(r"[\W_]+")
_MARKS = ("copyright", "(c)", "©", "all rights reserved")
_SPELLED = [(re.compile(rf"\b{a}\b"), a, b) for a, b in SPELLINGS.items()]


def canonical_line(line: str) -> str:
    """The canonical form of one line; empty for copyright lines."""
    low = line.lower()
    if any(m in low for m in _MARKS) and _COPYRIGHT.match(low.strip()):
        return ""
    out = _REST.sub(" ", low).strip()
    for pattern, a, b in _SPELLED:
        if a in out:
            out = pattern.sub(b, out)
    return out


def canonical(text: str | None) -> str:
    """The canonical form of a whole text: that of its lines, joined by spaces."""
    return " ".join(c for c in map(canonical_line, (text or "").split("\n")) if c)


def digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def known_digests() -> dict[str, str]:
    """Digest to licence, of all known texts and notices."""
    return {digest(canonical(t)): name for name, texts in [*NOTICES.items(), *((k, [v]) for k, v in TEXTS.items())] for t in texts}


def digests_of(texts: DataFrame, name: str = "license_id", text: str = "text") -> dict[str, str]:
    """Digest to licence, of a table of licence texts (a public list of a few hundred; it is held by the driver), beside the known ones."""
    rows = texts.where(F.col(text).isNotNull()).select(name, text).collect()
    return known_digests() | {digest(canonical(r[1])): r[0] for r in rows}


def license_scan(df: DataFrame, text: str = "text", carry: list[str] | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """Each row's ``carry`` columns (default doc_id), text_digest, license_id, notices and n_notice_lines.

    license_id is the licence whose known text or notice the whole text is, else null; notices are the
    licences named by lines of the text, sorted, and n_notice_lines is the number of such lines. Null and
    empty texts, and texts of copyright lines alone, have the empty canonical form and no licence. Whole texts are
    digested, whatever their length; of two licences with one canonical form the later one of ``known`` counts. Repeated
    rows are rows of their own; an empty table stays empty. ``known`` maps digests to licences (see ``digests_of``).
    """
    carry = carry or ["doc_id"]
    spark = df.sparkSession
    known = known_digests() if known is None else known
    (body,) = fresh(carry, "body")
    by_form: dict[str, str] = dict(known)
    quoted = [F.col(f"`{c}`") for c in carry]
    narrow = df.select(*quoted, F.col(text).alias(body))
    more = T._parse_datatype_string("text_digest string, notices array<string>, n_notice_lines bigint")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, body):
                digests, notices, counts = [], [], []
                for t in b.column(body).to_pylist():
                    lines = [c for c in map(canonical_line, (t or "").split("\n")) if c]
                    found = [by_form[x] for c in lines if (x := digest(c)) in by_form]
                    digests.append(digest(" ".join(lines)))
                    notices.append(sorted(set(found)))
                    counts.append(len(found))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(digests, pa.string()), pa.array(notices, pa.list_(pa.string())), pa.array(counts, pa.int64())], [*carry, *(f.name for f in more.fields)])

    forms = arrow_map(narrow, scan, T.StructType([*(narrow.schema[c] for c in carry), *more.fields]))
    rows = spark.createDataFrame(sorted(known.items()), "text_digest string, license_id string")
    return forms.join(F.broadcast(rows), "text_digest", "left").select(*quoted, "text_digest", "license_id", "notices", "n_notice_lines")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op2_license_scan": op2_license_scan}, {}
