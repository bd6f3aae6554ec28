import re
import textwrap

import duckdb
import oracle_check

from flowsieve.llm import licences as L


def text_of(*ids, wrap=70, prefix=""):
    return "\n\n".join("\n".join(prefix + x for x in textwrap.wrap(L.SENTENCES[k][0], wrap)) for k in ids)


def test_every_known_sentence_is_hinted_at_and_one_sentence():
    openings = set(L._openings())
    for s in [*L._table(), *L._references()]:
        assert re.search(L.HINT, s), s
        assert s.split(' ')[0] in openings
    for many in L.SENTENCES.values():
        for s in many:
            assert not re.search(L.END, s), s


def test_rules(spark):
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Foo\n\n" + text_of("MIT-GRANT", "MIT-NOTICE", "MIT-NONE")),
        (2, text_of("GPL2-GRANT", "GPL-NONE", "GPL-SEE", prefix="# ")),
        (3, text_of("APACHE-HEAD", "APACHE-COPY") + "\n\nhttp://x.org/licenses\n\n" + text_of("APACHE-NONE", "APACHE-SEE")),
        (4, text_of("MIT-NOTICE", "MIT-GRANT", "MIT-NONE")),
        (5, "some line\nReleased under the  MIT license!\nanother"),
        (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (7, text_of("MIT-GRANT", "MIT-NOTICE") + "\n\n" + "x.\n\n" * 4 + text_of("MIT-NONE")),
    ]
    found = {r["doc_id"]: r["licences"] for r in L.find_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {
        1: "MIT:text:1,MIT:title:1,notice:statement:1",
        2: "GPL-2.0:header:1",
        3: "Apache-2.0:header:1",
        4: "",  # the order is wrong
        5: "MIT:reference:1",
        6: "CC-BY-NC-4.0:reference:2",
        7: "",  # too much in between
    }


APACHE = """# Copyright 2020 Foo
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os"""
LGPL = """/*
 * A library
 *
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 */"""
BSD = """Copyright (c) 2019-2021, Acme Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
#: Texts and what a reader finds in them.
BY_HAND = [
    ("Copyright 2020 Acme\nLicensed under the MIT License.", "notice:statement:1,MIT:reference:1"),
    ("Copyright (c) 2020 Acme\nAll rights reserved.", "proprietary:statement:1,notice:statement:1"),
    ("Copyright 2020 Acme. All rights reserved.", "proprietary:statement:1,notice:statement:1"),
    (APACHE, "Apache-2.0:header:1,notice:statement:1"),
    (APACHE.replace("# ", "// ").replace("#", "//"), "Apache-2.0:header:1,notice:statement:1"),
    (LGPL, "LGPL-2.1:header:1"),
    (BSD, "BSD-2-Clause:text:1,proprietary:statement:1,notice:statement:1"),
    ("Licensed under the Apache License 2.0", "Apache-2.0:reference:1"),
    ("Licensed under MIT", "MIT:reference:1"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0:reference:1"),
    ("A title without full stop\nThis project is licensed under\nthe terms of the GNU\nAGPLv3\nmore", "AGPL-3.0:reference:1"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.", "GPL-3.0:text:1"),
    ("This module is MIT licensed.\nMIT-licensed\nmore", "MIT:reference:1"),
    ("We talk about the Apache License, Version 2.0, and warranty in general.", ""),
    ("copyright law has changed since 2020\nfree software", ""),
    ("The Software is licensed under the\nMIT License", "MIT:title:1"),
    ("This work is licensed under\na Creative Commons Attribution 4.0\nInternational License.", "CC-BY-4.0:reference:1"),
]


def test_by_hand(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BY_HAND)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licences"] for r in L.find_licences(docs).collect()}
    assert found == {k: e for k, (_, e) in enumerate(BY_HAND)}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert oracle_check.compare(con, L.sql(), L.find_licences(docs)) == []


def test_a_long_text(spark):
    """Time grows with the lines: a hundred thousand without a full stop, and as many sentences."""
    lines = "\n".join(["the licence of this", "MIT License", "permission is"] * 30_000)
    docs = spark.createDataFrame([(1, lines), (2, lines.replace("\n", ". ") + ".")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licences"] for r in L.find_licences(docs).collect()}
    assert found == {1: "MIT:title:30000", 2: "MIT:title:30000"}


def test_edge_rows(edge, nothing):
    rows = L.find_licences(edge).collect()
    assert len(rows) == edge.count() and all(r["licences"] == "" and r["n_sentences"] == 0 for r in rows)
    assert L.find_licences(nothing).count() == 0
