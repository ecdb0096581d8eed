"""Public licence texts as files and headers hold them, wrapped at several widths."""

import textwrap

import pytest

pytest.importorskip("breakweave.llm.queries")

from breakweave.llm import licenses  # noqa: E402

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
BSD3 = f"""{BSD2}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD2 + END, "BSD-3-Clause": BSD3 + END, "GPL-3.0": GPL, "GPL-2.0": GPL.replace("version 3", "version 2"), "Apache-2.0": APACHE, "MPL-2.0": MPL}


def wrapped(text, width, mark, end):
    lines = [x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
    return end.join(f"{mark}{x}".rstrip() for x in lines)


def test_whole_texts(spark):
    forms = [(w, m, e) for w in (72, 74, 76, 78, 80, 10_000) for m in ("", "# ", " * ", "// ") for e in ("\n", "\r\n")]
    rows = [(name, wrapped(t, *f)) for name, t in TEXTS.items() for f in forms]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, [s["license"] for s in r.spans]) for r in licenses.scan_licenses(docs).collect()}
    assert {i: got[i] for i in got} == {i: ([name], [name]) for i, (name, _) in enumerate(rows)}


def test_sentences_end_at_blank_lines(spark):
    texts = ["this project is licensed\n\nunder the MIT license", "this project is licensed; under the MIT license", "no stop here\nLicensed under the MIT License\nand on", "a) Licensed under\nthe MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert got == {0: [], 1: [], 2: ["MIT"], 3: ["MIT"]}
