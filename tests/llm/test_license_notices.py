"""Official notices, verbatim, plain and in comments."""

import pytest

from cairngraph.llm import licenses

APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0
"""
GPL3 = """<one line to give the program's name and a brief idea of what it does.>
Copyright (C) <year>  <name of author>

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NAMED = GPL3.replace("This program", "Cairn")


def commented(text: str) -> str:
    return "\n".join(("# " + line).rstrip() for line in text.split("\n"))


#: (text, its only rule or None for any, licence)
CASES = [
    (APACHE, "apache-header", "Apache-2.0"),
    (commented(APACHE.split("\n\n", 1)[1]), "apache-comment", "Apache-2.0"),
    (commented(APACHE.split("\n\n", 1)[1]).replace("http:", "https:"), None, "Apache-2.0"),
    (ASF, "apache-asf", "Apache-2.0"),
    (GPL3, "gpl3-header", "GPL-3.0-or-later"),
    (commented(GPL3.split("\n\n", 1)[1]), "gpl3-header", "GPL-3.0-or-later"),
    (NAMED, "gpl3-free", "GPL-3.0-or-later"),
    (GPL2, "gpl2-header-semicolon", "GPL-2.0-or-later"),
    (GPL2.replace("Foundation; either", "Foundation, either"), "gpl2-header", "GPL-2.0-or-later"),
    (GPL2.split("\n\n")[0], "gpl2-semicolon", "GPL-2.0-or-later"),
    (GPL2.split("\n\n")[0].replace("; either version 2 of the License, or\n(at your option) any later version.", "; version 2 of the License."), "gpl2-version", "GPL-2.0-only"),
    (MPL, "mpl-header-https", "MPL-2.0"),
    (commented(MPL).replace("https:", "http:"), "mpl-header", "MPL-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0\n// Copyright 2020 Some Body\nint x;", "spdx-apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0 */\n#include <x.h>", "spdx-gpl-2.0", "GPL-2.0-only"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "spdx-mit,spdx-apache-2.0", "Apache-2.0,MIT"),
    ("Komm bitte mit.\nmit\nISC", "", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: (r.rules, r.licenses) for r in licenses.scan(df).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_official_notices(found, case):
    rules, names = found[case]
    assert names == CASES[case][2] and CASES[case][1] in (None, rules)


def test_known_sentences_are_units():
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert {i for *_, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


def test_both_readings_count(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    line = "Licensed under CC0 1.0\nint x = 1\n"
    rows = [(1, line + "\n" + mit), (2, mit + "\n" + line * 5), (3, "# Copyright 2020 Some Body\n#\n" + commented(APACHE.split("\n\n", 1)[1]))]
    got = {r.doc_id: (r.rules, r.licenses, r.n_known) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit-full,cc0", "CC0-1.0,MIT", 4) and got[2] == ("mit-full,cc0", "CC0-1.0,MIT", 8)
    assert got[3][:2] == ("apache-comment", "Apache-2.0")


def test_the_same_licence_twice_leaves_no_part_of_itself(spark):
    one = ". ".join(licenses.SENTENCES[i] for i in ("mit_grant", "mit_notice", "as_is_mit")) + ".\n\n"
    df = spark.createDataFrame([(1, one * 2), (2, one * 3), (2, one * 3), (3, "x" * 300_000 + "\n\n" + one), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.rules) for r in licenses.scan(df).collect())
    assert got == [(1, "mit-full"), (2, "mit-full"), (2, "mit-full"), (3, "mit-full"), (4, "")]
