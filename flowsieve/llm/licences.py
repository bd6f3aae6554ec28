"""Licence scans by sentence: known sentences to identifiers, identifiers in order to licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import let, text_of

# Sentences of licences, by identifier. Case, punctuation and the breaking of lines do not
# matter; references and their identifiers are made from the names below.
SENTENCES = {
    "MIT-TITLE": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-GRANT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "MIT-NOTICE": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    ],
    "MIT-NONE": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    ],
    "MIT-LIABLE": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "ISC-GRANT": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "ISC-NONE": [
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    ],
    "APACHE-TITLE": ["Apache License Version 2.0, January 2004"],
    "APACHE-TERMS": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "APACHE-HEAD": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this software except in compliance with the License.',
    ],
    "APACHE-COPY": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE-NONE": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ],
    "APACHE-SEE": [
        "See the License for the specific language governing permissions and limitations under the License."
    ],
    "BSD-GRANT": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ],
    "BSD-SOURCE": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ],
    "BSD-BINARY": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "BSD-NAME": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "BSD-NONE": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    ],
    "BSD-LIABLE": [
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
    "GPL3-TITLE": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL2-TITLE": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GNU-VERBATIM": [
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ],
    "GPL3-GRANT": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "GPL2-GRANT": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "GPL-NONE": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "GPL-SEE": ["See the GNU General Public License for more details."],
    "LGPL21-GRANT": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "LGPL3-GRANT": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-SEE": ["See the GNU Lesser General Public License for more details."],
    "AGPL3-GRANT": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "AGPL-SEE": ["See the GNU Affero General Public License for more details."],
    "MPL2-HEAD": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "EPL2-HEAD": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "ZLIB-NONE": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZLIB-LIABLE": [
        "In no event will the authors be held liable for any damages arising from the use of this software."
    ],
    "ZLIB-GRANT": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "BSL-TITLE": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "BSL-GRANT": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
    ],
    "CC0-HEAD": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."
    ],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain."],
    "RESERVED": ["All rights reserved.", "All rights reserved worldwide."],
}
# How a text refers to a licence, and what licences are called, by licence.
FORMS = [
    "{}-licensed.",
    "Available under {}.",
    "Distributed under {}.",
    "Distributed under the terms of {}.",
    "Licensed under {}.",
    "Licensed under the terms of {}.",
    "Published under {}.",
    "Released under {}.",
    "This code is licensed under {}.",
    "This file is licensed under {}.",
    "This library is licensed under {}.",
    "This package is licensed under {}.",
    "This program is licensed under {}.",
    "This project is licensed under {}.",
    "This project is licensed under the terms of {}.",
    "This software is licensed under {}.",
    "This software is released under {}.",
    "This work is licensed under {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
]
NAMES = {
    "MIT": ["MIT", "the MIT License", "MIT License", "an MIT License", "a MIT License"],
    "ISC": ["ISC", "the ISC License", "ISC License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0", "the Apache License v2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause", "BSD 3-Clause"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause", "BSD 2-Clause"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL, version 3", "the GPL, version 3", "GPLv3", "the GPLv3", "GPL-3.0", "the GNU GPLv3"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL, version 2", "the GPL, version 2", "GPLv2", "the GPLv2", "GPL-2.0", "the GNU GPLv2"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3", "the LGPLv3", "LGPL-3.0", "the GNU LGPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1", "the LGPLv2.1", "LGPL-2.1"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3", "the AGPLv3", "AGPL-3.0", "the GNU AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "the MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "EPL-2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"],
    "Zlib": ["the zlib License", "zlib License", "Zlib"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0-1.0", "the CC0 1.0 Universal License"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Identifiers that stand for one of two forms of a licence.
VARIANTS = {k: ["-only", "-or-later", "+"] for k in NAMES if "GPL" in k}
#: Licence, kind, and the identifiers that make it, in their order. A reference is a rule of its own.
RULES = [
    ("MIT", "text", ["MIT-GRANT", "MIT-NOTICE", "MIT-NONE"]),
    ("MIT", "title", ["MIT-TITLE"]),
    ("ISC", "text", ["ISC-GRANT", "ISC-NONE"]),
    ("Apache-2.0", "text", ["APACHE-TITLE", "APACHE-TERMS"]),
    ("Apache-2.0", "header", ["APACHE-HEAD", "APACHE-COPY", "APACHE-NONE", "APACHE-SEE"]),
    ("BSD-3-Clause", "text", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME"]),
    ("BSD-2-Clause", "text", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("GPL-3.0", "text", ["GPL3-TITLE", "GNU-VERBATIM"]),
    ("GPL-3.0", "header", ["GPL3-GRANT", "GPL-NONE", "GPL-SEE"]),
    ("GPL-2.0", "text", ["GPL2-TITLE", "GNU-VERBATIM"]),
    ("GPL-2.0", "header", ["GPL2-GRANT", "GPL-NONE", "GPL-SEE"]),
    ("LGPL-3.0", "header", ["LGPL3-GRANT", "GPL-NONE", "LGPL-SEE"]),
    ("LGPL-2.1", "header", ["LGPL21-GRANT", "GPL-NONE", "LGPL-SEE"]),
    ("AGPL-3.0", "header", ["AGPL3-GRANT", "GPL-NONE", "AGPL-SEE"]),
    ("MPL-2.0", "header", ["MPL2-HEAD"]),
    ("EPL-2.0", "header", ["EPL2-HEAD"]),
    ("BSL-1.0", "text", ["BSL-GRANT"]),
    ("Zlib", "text", ["ZLIB-NONE", "ZLIB-LIABLE", "ZLIB-GRANT"]),
    ("CC0-1.0", "statement", ["CC0-HEAD"]),
    ("Unlicense", "text", ["UNLICENSE"]),
    ("proprietary", "statement", ["RESERVED"]),
    ("notice", "statement", ["COPYRIGHT"]),
]
RULES += [(name, "reference", [f"{name}-REF"]) for name in NAMES]
#: Other sentences that may stand between two of a rule, such as a web address.
GAP = 3
#: Every known sentence has one of these words; texts without them need no splitting.
HINT = r"(?i)licen[cs]e|permi|warrant|redistribut|copyright|reserved|free software|public domain|unencumbered|liable|terms and conditions|ed under|available under"
SPACE = r"\x20\x09-\x0D"
#: An empty line, or one of comment marks and rulers only.
PARAGRAPH = rf"\n[{SPACE}#*/;%=<>!-]*\n"
COPYRIGHT = r"^copyright (c )?[0-9]{4}( |$)"
OPENING = r"^[a-z0-9]+( [a-z0-9]+)?"
CUT = "\x1e"
END = rf"([.!?])[{SPACE}]+"
#: A known sentence may be broken over so many lines.
LINES = 16


def normalised(sentence: str) -> str:
    """As the columns are: runs of other signs than letters and digits are one blank."""
    import re

    return re.sub("[^A-Za-z0-9]+", " ", sentence).lower().strip(" ")


def _table() -> dict[str, str]:
    """Identifier of every sentence of a licence, normalised."""
    return {normalised(s): k for k, many in SENTENCES.items() for s in many}


def _names() -> dict[str, str]:
    """Identifier of every name that a reference may give, normalised."""
    names = {k: [*many, *[f"{k}{v}" for v in ["", *VARIANTS.get(k, [])]]] for k, many in NAMES.items()}
    return {normalised(n): f"{k}-REF" for k, many in names.items() for n in many}


def _references() -> list[str]:
    """All sentences that refer to a licence, normalised."""
    return [normalised(form.format(name)) for form in FORMS for name in _names()]


def _openings() -> list[str]:
    """How known sentences begin: a line that does not is not looked up."""
    return sorted({" ".join(s.split(" ")[:n]) for s in [*_table(), *_references()] for n in (1, 2)})


def _form() -> str:
    """What a reference has before the name of the licence, or after it."""
    parts = [f"^{normalised(f)} " if f.endswith("{}") or f.endswith("{}.") else f" {normalised(f)}$" for f in FORMS]
    return "|".join(sorted(parts, key=lambda p: (-len(p), p)))


def _normal(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def _identifier(normal: Column, known: Column, names: Column) -> Column:
    """Of a sentence, or of a reference by the name that is left of it."""
    return F.coalesce(
        F.try_element_at(known, normal),
        F.when(normal.rlike(_form()), F.try_element_at(names, F.regexp_replace(normal, _form(), ""))),
    )


def _in_lines(lines: Column, known: Column, names: Column, openings: Column) -> Column:
    """Identifiers of the known sentences that fill whole lines, the longest from each line on; one that begins
    within another is left out."""

    def at(line: Column, i: Column) -> Column:
        runs = F.transform(
            F.sequence(F.least(F.lit(LINES), F.size(lines) - i), F.lit(1)),
            lambda n: F.struct(
                i.alias("i"),
                n.alias("n"),
                let(F.array_join(F.slice(lines, i + 1, n), " "), lambda run: _identifier(run, known, names)).alias("id"),
            ),
        )
        opens = F.array_contains(openings, F.regexp_extract(line, OPENING, 0))
        best = F.when(opens, F.get(F.filter(runs, lambda r: r["id"].isNotNull()), F.lit(0)))
        notice = F.struct(i.alias("i"), F.lit(1).alias("n"), F.lit("COPYRIGHT").alias("id"))
        return F.coalesce(best, F.when(line.rlike(COPYRIGHT), notice))

    found = F.filter(F.transform(lines, at), lambda m: m.isNotNull())

    def first(all_found: Column) -> Column:
        own = F.filter(
            all_found,
            lambda m, k: ~F.exists(
                F.slice(all_found, F.greatest(k - LINES, F.lit(0)) + 1, F.least(k, F.lit(LINES))),
                lambda before: before["i"] + before["n"] > m["i"],
            ),
        )
        return F.transform(own, lambda m: m["id"])

    return let(found, first)


def pattern(ids: list[str]) -> str:
    return rf"(?:<\?>){{0,{GAP}}}".join(f"<{k}>" for k in ids)


def find_licences(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, ``n_sentences`` recognised, their ``identifiers`` in order, ``licences``.

    Sentences end at ``.!?`` and white space, or at a line that is empty but for comment marks. What is not known
    as a whole is looked up over runs of successive lines; a notice of copyright is a line. ``licences`` lists
    the rules that match as licence:kind:times, in the order of the rules; up to three other sentences may stand
    between those of a rule. Null and empty texts have none, repeated rows give equal rows, ids may be null, other
    columns are not read. A long text is held whole, in time proportional to its lines.
    """
    known, names = (F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for t in (_table(), _names()))
    openings = F.array(*[F.lit(x) for x in _openings()])
    body = text_of(text)
    cut = F.split(F.regexp_replace(F.regexp_replace(body, PARAGRAPH, CUT), END, f"$1{CUT}"), CUT)

    def of_sentence(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\n"), _normal), lambda x: x != "")
        return let(
            F.struct(lines.alias("lines"), let(_normal(s), lambda n: _identifier(n, known, names)).alias("whole")),
            lambda c: F.when(c["whole"].isNotNull(), F.array(c["whole"])).otherwise(
                let(_in_lines(c["lines"], known, names, openings), lambda ids: F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("?"))))
            ),
        )

    ids = F.when(body.rlike(HINT), F.flatten(F.transform(cut, of_sentence))).otherwise(F.array().cast("array<string>"))
    df = docs.select(F.col(id_col), ids.alias("ids"))
    real = F.filter("ids", lambda x: x != "?")
    df = df.select(id_col, real.alias("real"), F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")).alias("line"))

    def stated(licence: str, kind: str, rule: list[str]) -> Column:
        times = F.regexp_count("line", F.lit(pattern(rule)))
        return F.when(times > 0, F.concat(F.lit(f"{licence}:{kind}:"), times.cast("string")))

    found = [stated(*rule) for rule in RULES]
    return df.select(
        id_col,
        F.size("real").cast("bigint").alias("n_sentences"),
        F.array_join("real", " ").alias("identifiers"),
        F.when(F.size("real") > 0, F.array_join(F.array(*found), ",")).otherwise("").alias("licences"),
    )


def sql() -> str:
    """The operator on table ``documents`` in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows, names = (", ".join(f"({quote(n)}, {quote(k)})" for n, k in t.items()) for t in (_table(), _names()))
    look = lambda n: f"left join known on sentence = {n} left join names on regexp_matches({n}, {quote(_form())}) and name = regexp_replace({n}, {quote(_form())}, '', 'g')"
    rules = ", ".join(
        f"case when len(regexp_extract_all(line, {quote(pattern(k))})) > 0 then "
        f"{quote(f'{licence}:{kind}:')} || len(regexp_extract_all(line, {quote(pattern(k))})) end"
        for licence, kind, k in RULES
    )
    normal = lambda c: f"trim(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"""
with known(sentence, known_id) as (values {rows}), names(name, name_id) as (values {names}),
d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
s as (
  select r, generate_subscripts(a, 1) i, unnest(a) s from (
    select r, string_split(regexp_replace(regexp_replace(t, {quote(PARAGRAPH)}, chr(30), 'g'), {quote(END)}, '\\1' || chr(30), 'g'), chr(30)) a
    from d where regexp_matches(t, {quote(HINT)}))
), w as (
  select r, i, s, coalesce(known_id, name_id) id from (select *, {normal("s")} n from s) {look("n")}
), l as (
  select r, i, list_filter(list_transform(string_split(s, chr(10)), lambda x: {normal("x")}), lambda x: x <> '') a from w where id is null
), m as (
  select r, i, j, k, array_to_string(a[j:j + k - 1], ' ') n from (
    select *, unnest(range(1, least({LINES}, len(a) - j + 1) + 1)) k from (select *, unnest(range(1, len(a) + 1)) j from l))
), b as (
  select r, i, j, max(k) k, arg_max(coalesce(known_id, name_id), k) id from m {look("n")} where known_id is not null or name_id is not null group by r, i, j
), c as (
  select * from b union all
  select r, i, j, 1, 'COPYRIGHT' from m where k = 1 and regexp_matches(n, {quote(COPYRIGHT)}) and (r, i, j) not in (select (r, i, j) from b)
), g as (
  select r, i, list(id order by j) ids from c
  where not exists (select 1 from c p where p.r = c.r and p.i = c.i and p.j < c.j and p.j + p.k > c.j) group by r, i
), o as (
  select w.r, w.i, case when w.id is not null then [w.id] when len(g.ids) > 0 then g.ids else ['?'] end ids from w left join g using (r, i)
), q as (
  select r, flatten(list(ids order by i)) ids from o group by r
), z as (
  select doc_id, list_filter(coalesce(ids, []), lambda x: x <> '?') k, '<' || array_to_string(coalesce(ids, []), '><') || '>' line from d left join q using (r)
)
select doc_id, len(k)::bigint n_sentences, coalesce(array_to_string(k, ' '), '') identifiers,
  case when len(k) > 0 then array_to_string(list_filter([{rules}], lambda x: x is not null), ',') else '' end licences
from z
"""
