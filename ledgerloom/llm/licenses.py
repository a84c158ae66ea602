"""Licence recognition by sentence rules.

A text is split into sentences, each normalised and looked up among known licence sentences. The identifiers found, in
their order, are matched against rules: ordered sequences of identifiers that together name a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_blocks, text_or_empty

#: Sentences that may lie between two sentences of a rule.
GAP = 2
#: The sentence that many notices hold beside their licence.
RIGHTS = "rights"

#: Sentences of published licences and notices, by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-3-short": "Licensed under the BSD 3-Clause License.",
    "bsd-short": "Licensed under the BSD License.",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-4-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse-name": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "lgpl-21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-subject": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-notice": "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-mpl": "SPDX-License-Identifier: MPL-2.0",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "rights": "All rights reserved.",
}
#: Rules by licence, most telling first; a rule holds where its sentences follow one another.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("bsd-0-grant", "isc-warranty")),
    ("0BSD", ("bsd-0-grant",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-text",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("Apache-2.0", ("apache-short",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-4-advertise")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("BSD", ("bsd-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-2.0-only", ("gpl-2-only",)),
    ("LGPL-2.1-or-later", ("lgpl-21-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("GPL-3.0", ("gpl-3-work",)),
    ("GPL-2.0", ("gpl-2-work",)),
    ("MPL-2.0", ("mpl-subject", "mpl-obtain")),
    ("MPL-2.0", ("mpl-subject",)),
    ("EPL-2.0", ("epl-subject",)),
    ("BSL-1.0", ("bsl-grant", "bsl-notice")),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-public", "unlicense-use")),
    ("Unlicense", ("unlicense-public",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC0-1.0", ("cc0",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("GPL-2.0-only", ("spdx-gpl-2",)),
    ("GPL-2.0-or-later", ("spdx-gpl-2-later",)),
    ("GPL-3.0-only", ("spdx-gpl-3",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("MPL-2.0", ("spdx-mpl",)),
    ("Proprietary", ("rights",)),
]

#: A sentence ends at a stop, mark or colon before a space, at a blank line, or at the end.
_END = re.compile(rb"(?<=[.!?:;])[ \t\r]+|(?<=[.!?:;])\n|\n[ \t\r]*\n|\Z")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normalised(sentence: bytes) -> bytes:
    return b" ".join(sentence.translate(_FOLD).split())


Line = tuple[int, int, bytes]


def sentences(text: bytes) -> Iterator[list[Line]]:
    """The lines of each sentence: (start, end, normalised) in bytes, those without words left out. A sentence without
    words has no lines."""
    first = 0
    for m in _END.finditer(text):
        part = text[first : m.start()]
        if part and not part.isspace():
            lines, at = [], first
            for line in part.split(b"\n"):
                if own := normalised(line):
                    lines.append((at, at + len(line), own))
                at += len(line) + 1
            yield lines
        first = m.end()


class Known:
    """Known sentences, each as the pieces into which sentences() splits it. By the first piece: the pieces and the
    identifier; by its first word: the most words of such a piece."""

    def __init__(self, known: dict[str, str]) -> None:
        self.pieces: dict[bytes, list[tuple[list[bytes], str]]] = {}
        self.most: dict[bytes, int] = {}
        for name, text in known.items():
            own = [b" ".join(x[2] for x in lines) for lines in sentences(text.encode()) if lines]
            if not own:
                continue
            self.pieces.setdefault(own[0], []).append((own, name))
            word = own[0].split(b" ", 1)[0]
            self.most[word] = max(self.most.get(word, 0), own[0].count(b" ") + 1)


def _prefix(lines: list[Line], piece: bytes) -> int:
    """How many of the first lines are the piece together; 0 where none are."""
    have = b""
    for k, x in enumerate(lines):
        have = have + b" " + x[2] if k else x[2]
        if len(have) >= len(piece):
            return k + 1 if have == piece else 0
    return 0


def hits(text: bytes, known: Known) -> list[tuple[int, int, str, int, int]]:
    """(first and last position among sentences, identifier, start, end) of the known sentences of a text. One may take
    whole lines of a sentence, so that a line of its own counts where the text before it has no stop."""
    out: list[tuple[int, int, str, int, int]] = []
    own = list(sentences(text))
    free: dict[int, int] = {}  # lines of later sentences that are taken already
    for k, lines in enumerate(own):
        i = free.pop(k, 0)
        while i < len(lines):
            most = known.most.get(lines[i][2].split(b" ", 1)[0], 0)
            have, n, best = b"", 0, None
            for j in range(i, len(lines)) if most else ():
                n += lines[j][2].count(b" ") + 1
                if n > most:
                    break
                have = have + b" " + lines[j][2] if j > i else lines[j][2]
                for pieces, name in known.pieces.get(have, ()):
                    last, line = k, j
                    for piece in pieces[1:]:
                        whole = line + 1 == len(own[last]) and last + 1 < len(own)
                        if not whole or not (taken := _prefix(own[last + 1], piece)):
                            break
                        last, line = last + 1, taken - 1
                    else:
                        if best is None or (last, line) > best[:2]:
                            best = last, line, name
            if best is None:
                i += 1
                continue
            last, line, name = best
            out.append((k, last, name, lines[i][0], own[last][line][1]))
            if last > k:
                free |= {x: len(own[x]) for x in range(k + 1, last)} | {last: line + 1}
                break
            i = line + 1
    return out


def characters(raw: bytes, places: list[int]) -> dict[int, int]:
    """For places in bytes those in characters, found in one pass."""
    out, last, n = {}, 0, 0
    for place in sorted(set(places)):
        n += len(raw[last:place].decode("utf-8"))
        out[place], last = n, place
    return out


def apply_rules(found: list[tuple[int, int, str, int, int]], rules: list[tuple[str, tuple[str, ...]]], gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that hold, in text order. Rules are tried in their order; a sentence serves one
    rule. A reservation of rights that leads to the first sentence of a longer rule is part of that notice and no licence."""
    free, out = [True] * len(found), []
    for licence, sequence in rules:
        for i, hit in enumerate(found):
            if not free[i] or hit[2] != sequence[0]:
                continue
            chain = [i]
            for name in sequence[1:]:
                far = found[chain[-1]][1] + gap + 1
                j = next((j for j in range(chain[-1] + 1, len(found)) if found[j][0] > far or free[j] and found[j][2] == name), None)
                if j is None or found[j][2] != name or found[j][0] > far:
                    break
                chain.append(j)
            if len(chain) == len(sequence):
                for j in chain:
                    free[j] = False
                before = i - 1
                if len(chain) > 1 and before >= 0 and found[before][2] == RIGHTS and found[before][1] + gap + 1 >= found[i][0]:
                    free[before] = False
                out.append((licence, found[chain[0]][3], found[chain[-1]][4]))
    return sorted(out, key=lambda x: x[1:])


def recognise(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, gap: int = GAP) -> DataFrame:
    """(doc_id, sentence_ids, licences, matches) for every row of docs.

    sentence_ids: identifiers of the known sentences in their order; matches: array of (licence, start, end), characters
    of the text, end exclusive; licences: their distinct licences, sorted. A null text has none; repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """
    lookup = Known(SENTENCES if known is None else known)
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            ids, matches = [], []
            for text in batch.column(1):
                raw = text.as_py()
                found = hits(raw, lookup)
                ids.append([x[2] for x in found])
                holds = apply_rules(found, rules, gap)
                at = characters(raw, [x for _, a, b in holds for x in (a, b)])
                matches.append([{"licence": n, "start": at[a], "end": at[b]} for n, a, b in holds])
            kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.string())), pa.array(matches, kind)], names=["doc_id", "sentence_ids", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, sentence_ids array<string>, matches array<struct<licence:string,start:long,end:long>>")
    return found.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.col("matches.licence"))).alias("licences"), "matches")


def scan(docs: DataFrame) -> DataFrame:
    """A row for every document: doc_id, n_sentences (known ones), sentence_ids, licences and matches, comma-joined. Null and
    empty texts have none; repeated rows stay; texts of any length are read as wholes; an empty table gives no rows; other
    columns are ignored, whatever their names."""
    one = F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["start"].cast("string"), m["end"].cast("string")))
    return recognise(docs).select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.array_join(one, ",").alias("matches"))
