import re
import time

import duckdb
import pytest

from newsweave.llm.licences import CUES, NAMES, RULES, SENTENCES, scan_licences
from newsweave.llm.queries import ORACLE

GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction."
)
NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software."
)
TEXTS = {
    1: ("Word. All rights reserved.\nLicensed under CC BY-NC 4.0.", "All-Rights-Reserved,CC-BY-NC-4.0", 2, 0),
    2: ("Released under the MIT License", "MIT", 1, 0),
    3: (f"{GRANT}\n\n{NOTICE}", "MIT", 2, 0),
    4: (f"{GRANT} In between. {NOTICE}", "", 2, 2),
    5: ("THIS WORK is licensed under the GNU General Public License, version 3.", "GPL-3.0", 1, 0),
    6: ("Licensed under the Apache License, Version 2.0!\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,Apache-2.0", 2, 0),
    7: ("", "", 0, 0),
    8: (None, "", 0, 0),
    9: ("license license", "", 0, 0),
    10: ("x. " * 3000 + "All rights reserved.", "All-Rights-Reserved", 1, 0),
}


def test_rules(spark):
    rows = [(i, t[0], "x", 1) for i, t in TEXTS.items()]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string, licences string, _ids int"))
    assert got.count() == len(rows)
    for row in got.collect():
        _, licences, known, left = TEXTS[row.doc_id]
        assert (row.licences, row.n_known, row.n_left) == (licences, known, left)
        assert row.n_licences == (licences.count(",") + 1 if licences else 0)
    assert scan_licences(spark.createDataFrame(rows, "doc_id long, text string, licences string, _ids int").limit(0)).collect() == []


MIT = '''MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD_NAME = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
BSD_END = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
'''
APACHE = '''Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
'''
HEAD = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
REAL = {
    "MIT": (MIT, 4),
    "BSD-2-Clause": (BSD + BSD_END, 5),
    "BSD-3-Clause": (BSD + BSD_NAME + BSD_END, 6),
    "Apache-2.0": (APACHE, 5),
    "GPL-3.0": (GPL, 5),
    "All-Rights-Reserved,BSD-3-Clause": (HEAD + BSD + BSD_NAME + BSD_END, 7),
}


def test_real_licences(spark):
    rows, expected = [], []
    for licences, (text, known) in REAL.items():
        joined = "\n\n".join(" ".join(part.split()) for part in text.split("\n\n"))
        forms = [text, text.replace("\n", "\r\n"), "# " + text.replace("\n", "\n# ")]
        if "Reserved" not in licences:
            forms += [joined, " ".join(text[text.index("Perm") if licences == "MIT" else text.find("Licensed") + (text.find("Licensed") < 0) :].split())]
        for form in forms:
            rows.append((len(rows), form))
            expected.append((licences, known))
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for row, (licences, known), (_, text) in zip(got, expected, rows, strict=True):
        assert (row.licences, row.n_left) == (licences, 0), text
        assert known - 1 <= row.n_known <= known, text


ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
'''
ZLIB = '''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
'''
UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
'''


def gnu(words, version, work="program"):
    return (
        GPL.replace("GNU General", f"GNU {words} General")
        .replace("version 3", f"version {version}")
        .replace("program", work)
    )


NOTICES = [
    ("Licensed under the Apache License, Version 2.0. This file is ours.", "Apache-2.0"),
    ("Licensed under the Apache License, Version\n# 2.0. This file is ours.", "Apache-2.0"),
    ("This work is licensed under CC BY 4.0. Please credit us.", "CC-BY-4.0"),
    ("this work is licensed under CC BY 4.0, thanks", "CC-BY-4.0"),
    ("Our text is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "CC-BY-NC-SA-3.0"),
    ("licensed under Creative Commons Attribution-Non Commercial 2.5", "CC-BY-NC-2.5"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later\nint main() {}", "LGPL-2.1"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("# SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
    ("It is released under the GNU GPL v2 or later.", "GPL-2.0"),
    ("released under the GPLv3", "GPL-3.0"),
    ("Distributed under the Boost Software License, Version 1.0. (See it.)", "BSL-1.0"),
    ("available under the terms of the Eclipse Public License v. 2.0 which is", "EPL-2.0"),
    ("provided under the ISC licence; and more", "ISC"),
    ("released under CC0 1.0 Universal", "CC0-1.0"),
    ("licensed under the mitre plan", ""),
    ("sublicensed under the MIT license", ""),
    ("licensed under\n\nthe MIT license", ""),
    ("1) All rights reserved. 2) Released into the public domain. c) nothing", "All-Rights-Reserved,Public-Domain"),
    (ISC, "ISC"),
    (ZLIB, "Zlib"),
    (" ".join(ZLIB.split()), "Zlib"),
    (MPL, "MPL-2.0"),
    ("/* " + MPL.replace("\n", "\n * "), "MPL-2.0"),
    (UNLICENSE, "Unlicense"),
    (gnu("Lesser", "2.1", "library"), "LGPL-2.1"),
    (gnu("Lesser", "3"), "LGPL-3.0"),
    (gnu("Affero", "3"), "AGPL-3.0"),
]


def test_notices(spark):
    rows = [(i, text) for i, (text, _) in enumerate(NOTICES)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, licences) in enumerate(NOTICES):
        assert (got[i].licences, got[i].n_left) == (licences, 0), (text, got[i])


def test_sql_on_wrapped_notices(spark):
    """The SQL does the same with wrapped lines, addresses, numerals, marks and odd texts."""
    texts = [text for text, _ in NOTICES] + [text for text, _ in REAL.values()] + [t[0] for t in TEXTS.values()]
    texts += ["# " + text.replace("\n", "\r\n# ") for text, _ in REAL.values()]
    texts += [" ".join(text.split()) for text, _ in REAL.values()]
    texts += ["....5....x. 5.5..5 .5 5.\n\n\n\n. . .", "\u2028. \u0130 All rights reserved.\u2028", "v. v.2 v", ": ; : ;", "\n" * 50]
    rows = list(enumerate(texts))
    columns = ["doc_id", "licences", "n_licences", "n_known", "n_left", "sentence_ids"]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").select(columns)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op2_sentence_licences']}) ORDER BY doc_id").fetchall()
    for mine, other in zip(got.collect(), sql, strict=True):
        assert tuple(mine) == other, texts[mine.doc_id]


@pytest.mark.parametrize("run", ["; ", ";", ": ", ":", " ", ".", ". ", "\n", " \n", "\t", "# \n", "\u3002:", "5.", "1. ", "v", "version ", "are "])
def test_long_runs(spark, run):
    """A megabyte of marks or blanks takes time in proportion to its length."""
    text = "All rights reserved. 5" + run * (1_000_000 // len(run)) + "x 5. Licensed under the MIT license."
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    row = scan_licences(frame).first()
    assert "MIT" in row.licences and time.monotonic() - start < 20


def test_tables():
    """Every identifier has one meaning, and every rule consists of known ones."""
    known = SENTENCES.keys() | NAMES.keys()
    assert all(part in known for _, parts in RULES for part in parts)
    assert {part for _, parts in RULES for part in parts} >= NAMES.keys()
    for table in (SENTENCES, NAMES):
        listed = [text for texts in table.values() for text in texts]
        assert len(listed) == len(set(listed))
        assert all(re.fullmatch("[a-z0-9]+(\\.[0-9]+)?( [a-z0-9]+(\\.[0-9]+)?)*", text) for text in listed)


def test_every_sentence_has_a_cue():
    assert all(re.search(CUES, known) for listed in SENTENCES.values() for known in listed if not known.startswith("if not see"))
