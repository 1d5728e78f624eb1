"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is normalised once (lower case, words of letters and digits). A unit is any run of its words, so whole
texts, notices inside a sentence, wrapped over lines or set behind comment marks. Units and templates become
multisets of word bigrams; Dice = 2 * common / (bigrams of both). As common <= the smaller, a template of b
bigrams can reach t only for units of b * t / (2 - t) to b * (2 - t) / t bigrams that hold b * t / (2 - t) of its
own: texts and starts without so many near each other are pruned before any unit is compared. A unit that begins
or ends with a bigram foreign to the template is worse than the one without it, and one that a template's own
bigram adjoins is better with it unless the unit already holds the template's number of that bigram. So units from
and to the ends of runs of own bigrams are compared, and all from own bigram to own bigram where a text holds one of
them more often than the template does; no unit that reaches t is lost. A template of one word pair or more is needed.

The pack holds notices and whole texts of common short licences; `pack` reads more from a folder.

Cases: null and empty texts match nothing; of the units with one start the best counts, and of those that overlap
the best again; ties go to the longer template and then to the first name; work grows with the text's length times
the longest template's; repeated rows give repeated rows; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches, prepare

LEAST = 0.8

#: Parts of the BSD licences, notices by which works commonly name their licences, and whole texts.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": f"""{_BSD_HEAD}
1. {_BSD_SOURCE}
2. {_BSD_BINARY}
{_BSD_END}""",
    "BSD-3-Clause-text": f"""{_BSD_HEAD}
1. {_BSD_SOURCE}
2. {_BSD_BINARY}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_END}""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def pack(folder: str) -> dict[str, str]:
    """Templates from a folder's plain text files, by file name."""
    return {f.stem if f.suffix == ".txt" else f.name: f.read_text(errors="replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.own = []  # name, bigrams, how many, fewest and most of a unit that can match
        self.of: dict[tuple[str, str], list[int]] = {}  # templates that a bigram is in
        for name, text in sorted(templates.items()):
            grams = bigrams(text)
            if n := grams.total():
                for g in grams:
                    self.of.setdefault(g, []).append(len(self.own))
                self.own.append((name, grams, n, math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)))

    def units(self, k: int, places: list[tuple[int, tuple[str, str]]]) -> list[tuple[float, int, int]]:
        """(Dice, first word, last word) of the best unit of each start that reaches a template; places: of its bigrams, in order."""
        _, own, size, low, high = self.own[k]
        at = [i for i, _ in places]
        often = Counter(g for _, g in places)
        every = any(n > own[g] for g, n in often.items())
        begins = [every or j == 0 or at[j - 1] < i - 1 for j, i in enumerate(at)]
        closes = [every or j == len(at) - 1 or at[j + 1] > i + 1 for j, i in enumerate(at)]
        out = []
        for first, a in enumerate(at):
            if not begins[first] or first + low > len(at) or at[first + low - 1] >= a + high:
                continue
            left, common, best = dict(own), 0, None
            for j in range(first, len(at)):
                i, g = places[j]
                n = i - a + 1
                if n > high:
                    break
                if left[g]:
                    left[g] -= 1
                    common += 1
                if closes[j] and n >= low and (dice := 2 * common / (size + n)) >= self.least and (best is None or dice > best[0]):
                    best = (dice, a, i + 1)
            if best:
                out.append(best)
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(name, best Dice, units that reach it without overlap), best first."""
        if not text:
            return []
        words, of = _WORD.findall(text.lower()), self.of
        places: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for i, g in [(i, g) for i, g in enumerate(zip(words, words[1:], strict=False)) if g in of]:
            for k in of[g]:
                places.setdefault(k, []).append((i, g))
        found = []
        for k, at in places.items():
            name, _, size, low, high = self.own[k]
            if not any(b[0] - a[0] < high for a, b in zip(at, at[low - 1 :], strict=False)):
                continue
            taken, best, n = bytearray(len(words)), 0.0, 0
            for dice, a, b in sorted(self.units(k, at), key=lambda x: (-x[0], x[1])):
                if taken.find(1, a, b + 1) < 0:
                    taken[a : b + 1] = b"\1" * (b + 1 - a)
                    best, n = max(best, dice), n + 1
            if n:
                found.append((-best, -size, name, n))
        return [(name, -d, n) for d, _, name, n in sorted(found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, licence and dice of the best match (null without one), n_units (passages) that reach it, all licences found, for every row."""
    prepare(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def made():
        own = Scanner(templates, least)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.scan(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0][0] if x else None for x in found], pa.string()), pa.array([x[0][1] if x else None for x in found], pa.float64()),
                pa.array([x[0][2] if x else 0 for x in found], pa.int64()), pa.array([",".join(sorted(n for n, *_ in x)) for x in found], pa.string()),
            ], ["doc_id", "licence", "dice", "n_units", "licences"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over_batches(made), "doc_id long, licence string, dice double, n_units long, licences string")
