"""License scans by sentence rules.

Texts are cut into sentences; each is normalised (lower case, runs of anything but letters and
digits to one blank) and looked up among known licence sentences. The sequence of identifiers is
then matched against ordered rules, longest rule first, leftmost first, without overlap; at most
``max_gap`` unknown sentences may stand between two members.

Texts are read twice: line by line, where each line ends a sentence, and in paragraphs, where a line
break (with the next line's comment prefix) is white space and a sentence may begin with any line.
Blank and comment-only lines and lines that begin with a URL end a paragraph. Each rule looks in the
lines first; matches of the two readings do not overlap.

List marks ("1.", "a.", "*") are no sentences, so numbered conditions follow each other.

Edge cases: null and empty texts hold no licence; a sentence may run to the end of its line without
a mark; very long texts are scanned whole; of rules of equal length the one listed first goes first;
repeated rows are scanned each for itself; spans count code points of the original text; an input
column named like a result is replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattiq.llm.common import append_columns

#: Known sentences, as written in the licences' own texts and usual notices.
SENTENCES = {
    "mit_notice": "Released under the MIT License.",
    "mit_notice_2": "Licensed under the MIT License.",
    "mit_notice_3": "This project is licensed under the terms of the MIT license.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl_include": "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "bsl_notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_notice": "Licensed under the BSD 3-Clause License.",
    "bsd_notice_2": "Licensed under the BSD 2-Clause License.",
    "bsd_style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc_notice": "Licensed under the ISC License.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "apache_notice": "Licensed under the Apache License, Version 2.0.",
    "apache_named": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_obtain": "You may obtain a copy of the License at",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache_copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl_notice": "Licensed under the Mozilla Public License 2.0.",
    "epl_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at",
    "epl_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl2_notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2_only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl21_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0_waive": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0_without": "This software is distributed without any warranty.",
    "cc0_notice": "Licensed under CC0 1.0.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc_by_4": "Licensed under CC BY 4.0.",
    "cc_by_sa_4": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_4": "Licensed under CC BY-NC 4.0.",
    "cc_by_nd_4": "Licensed under CC BY-ND 4.0.",
    "cc_by_nc_sa_4": "Licensed under CC BY-NC-SA 4.0.",
    "cc_by_nc_nd_4": "Licensed under CC BY-NC-ND 4.0.",
    "cc_by_4_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_4_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc_by_nc_4_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "reserved": "All rights reserved.",
    "spdx": "SPDX-License-Identifier:",
}
#: Ordered rules: licence, sentence identifiers in order.
RULES = (
    ("MIT", ("mit_grant", "mit_include", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_include", "mit_as_is")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_notice_2",)),
    ("MIT", ("mit_notice_3",)),
    ("BSL-1.0", ("bsl_grant", "bsl_include")),
    ("BSL-1.0", ("bsl_notice",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-3-Clause", ("bsd_notice",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_notice_2",)),
    ("BSD-style", ("bsd_style",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_notice",)),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")),
    ("Apache-2.0", ("apache_named", "apache_comply", "apache_obtain")),
    ("Apache-2.0", ("apache_notice",)),
    ("Apache-2.0", ("apache_terms",)),
    ("Apache-2.0", ("apache_copyright",)),
    ("MPL-2.0", ("mpl_subject", "mpl_copy")),
    ("MPL-2.0", ("mpl_notice",)),
    ("EPL-2.0", ("epl_notice",)),
    ("EPL-2.0", ("epl_terms",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope")),
    ("GPL-2.0-only", ("gpl2_only", "gpl_hope")),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("GPL-2.0-only", ("gpl2_notice",)),
    ("LGPL-2.1-or-later", ("lgpl21_free", "lgpl_hope")),
    ("LGPL-3.0-or-later", ("lgpl3_free", "lgpl_hope")),
    ("AGPL-3.0-or-later", ("agpl_free", "gpl_hope")),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("CC0-1.0", ("cc0_waive", "cc0_without")),
    ("CC0-1.0", ("cc0_notice",)),
    ("WTFPL", ("wtfpl",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_4",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4_long",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4_long",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-4.0", ("cc_by_4_long",)),
    ("proprietary", ("reserved",)),
)
#: Licences whose identifier may follow the SPDX tag, as one more rule each.
TAGGED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
SENTENCES |= {f"tag_{x}": x for x in TAGGED}
RULES += tuple((x, ("spdx", f"tag_{x}")) for x in TAGGED)
_SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?:;]+(?=\s|$)|(?=\n|$))")
_RUN = re.compile(r"[^a-z0-9]+")
_MARK = re.compile(r"(?:[0-9]+|[a-z])?")
_LINE = re.compile(r"[^\n]+")
_PREFIX = re.compile(r"[ \t]*(?:<!--|/\*+!?|//+!?|\*+/?|#+|;+|--+|!+|%+|>+|::|\.\.(?=\s)|(?i:rem|dnl)(?=\s|$))?")
_SUFFIX = re.compile(r"[ \t]*(?:\*+/|--+>|\*+|#+)?[ \t\r]*$")
_URL = re.compile(r"\s*<?https?://", re.I)


@dataclass(frozen=True)
class LicenseParams:
    max_gap: int = 0


def normalise(sentence: str) -> str:
    return _RUN.sub(" ", sentence.lower()).strip()


def numbered(text: str) -> Iterator[tuple[int, re.Match]]:
    """The sentences but for list marks, with their numbers."""
    n = 0
    for m in _SENTENCE.finditer(text):
        if len(m[0]) > 8 or not _MARK.fullmatch(normalise(m[0])):
            yield n, m
            n += 1


def unwrap(text: str) -> str:
    """The text with blanks for comment marks and for line breaks inside paragraphs; places stay the same."""
    out, at, open_ = [], 0, False
    for m in _LINE.finditer(text):
        line = m[0]
        n = _PREFIX.match(line).end()
        body = line[n:]
        body = body[: _SUFFIX.search(body).start()]
        goes_on = open_ and m.start() == at + 1 and body.strip() and not _URL.match(body)
        out += [" " if goes_on else "\n" * (m.start() - at), " " * n, body, " " * (len(line) - n - len(body))]
        at, open_ = m.end(), bool(body.strip())
    return "".join(out) + "\n" * (len(text) - at)


class Scanner:
    def __init__(self, sentences=SENTENCES, rules=RULES, p: LicenseParams = LicenseParams()) -> None:
        if any(n not in sentences for _, r in rules for n in r):
            raise ValueError("a rule names an unknown sentence")
        cut = {k: [normalise(m[0]) for m in _SENTENCE.finditer(s)] for k, s in sentences.items()}  # an entry may hold several sentences
        self.p, self.known = p, {}
        for s in (s for parts in cut.values() for s in parts):
            self.known.setdefault(s, len(self.known))
        whole = [(licence, tuple(self.known[s] for n in names for s in cut[n])) for licence, names in rules]
        self.rules = sorted(whole, key=lambda r: -len(r[1]))
        self.longest = max((len(s) for s in self.known), default=0)
        self.anchors = sorted({max((w for n in names for s in cut[n] for w in s.split()), key=len) for _, names in rules})  # a text without any matches no rule

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, start, stop) of each match, in order."""
        if not text or not any(a in low for low in [text.lower()] for a in self.anchors):
            return []
        lines = []  # identifier, number of the sentence, start, stop
        for n, m in numbered(text):
            if (name := self.known.get(normalise(m[0]))) is not None:
                lines.append((name, n, m.start(), m.end()))
        readings = [lines, self._wrapped(text)] if "\n" in text else [lines]
        out, used = [], []  # used: disjoint places of matched sentences, in order
        for licence, names in self.rules:
            for found in readings:
                for i in range(len(found) - len(names) + 1):
                    part = found[i : i + len(names)]
                    if any(x[0] != y for x, y in zip(part, names)) or any(b[1] - a[1] - 1 > self.p.max_gap for a, b in zip(part, part[1:])) or any(self._taken(used, x) for x in part):
                        continue
                    for x in part:
                        insort(used, x[2:])
                    out.append((licence, part[0][2], part[-1][3]))
        return sorted(out, key=lambda x: x[1])

    @staticmethod
    def _taken(used: list[tuple[int, int]], x: tuple[int, int, int, int]) -> bool:
        i = bisect_left(used, (x[3],))  # those before begin before x stops
        return i > 0 and used[i - 1][1] > x[2]

    def _wrapped(self, text: str) -> list[tuple[int, int, int, int]]:
        """The known sentences of the paragraphs; each may begin with any line of what precedes its end."""
        flat, found = unwrap(text), []
        breaks = [m.end() for m in re.finditer("\n", text)]
        for n, m in numbered(flat):
            begins, k = [m.start()], bisect_left(breaks, m.end())
            while k and breaks[k - 1] > m.start():  # from the last line back, as far as a known sentence may reach
                k -= 1
                begins.append(breaks[k])
                if len(normalise(flat[breaks[k] : m.end()])) > self.longest:
                    break
            for i in sorted(begins):
                if (name := self.known.get(normalise(flat[i : m.end()]))) is not None:
                    i += len(flat[i : m.end()]) - len(flat[i : m.end()].lstrip())
                    found.append((name, n, i, m.end()))
                    break
        return found


SPAN = T.StructType([T.StructField("licence", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
FIELDS = [T.StructField("n_matches", T.LongType()), T.StructField("licences", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]


def scan_licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES, p: LicenseParams = LicenseParams()) -> DataFrame:
    """``docs`` with the number of matches, the distinct licences (sorted, comma-joined) and spans."""
    scanner = Scanner(sentences, rules, p)
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(column: pa.Array) -> list:
        rows = [scanner.scan(t) for t in column.to_pylist()]
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted({x[0] for x in r})) for r in rows], pa.string()), pa.array([[dict(zip(("licence", "start", "stop"), x)) for x in r] for r in rows], span)]

    return append_columns(docs, "text", run, FIELDS)


def oracle(sentences=SENTENCES, rules=RULES) -> str:
    """SQL over ``documents`` for the reading by lines: ordered rules over identifiers, longest first, then as listed, leftmost first.

    A match counts if none that goes before it takes one of its sentences. No rule's members may be
    cut apart by a match of lower precedence, so one pass from the longest length down does.
    """
    scanner = Scanner(sentences, rules)
    known = ", ".join(f"('{s}', {i})" for s, i in scanner.known.items())
    ruled = ", ".join(f"({n}, '{licence}', [{', '.join(map(str, names))}])" for n, (licence, names) in enumerate(scanner.rules))
    lengths = sorted({len(names) for _, names in scanner.rules}, reverse=True)
    steps, free = [], "SELECT doc_id, i FROM f"
    for n in lengths:  # sentences that a longer match has taken are no longer free
        steps.append(f"""m{n} AS (SELECT f.doc_id, f.i, r.licence, r.names FROM f JOIN r ON len(r.names) = {n} AND f.run[1:{n}] = r.names
  WHERE (SELECT count(*) FROM ({free}) x WHERE x.doc_id = f.doc_id AND x.i BETWEEN f.i AND f.i + {n - 1}) = {n})""")
        free += f" EXCEPT SELECT doc_id, unnest(range(i, i + {n})) FROM m{n}"
    union = " UNION ALL ".join(f"SELECT doc_id, licence FROM m{n}" for n in lengths)
    return rf"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(k, id)), r AS (SELECT * FROM (VALUES {ruled}) AS t(o, licence, names)),
s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), '. '), '[.!?:;]+(\s+|$)'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: NOT regexp_full_match(x, '([0-9]+|[a-z])?')) AS ks FROM documents),
n AS (SELECT doc_id, i, id FROM (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM s) JOIN known USING (k)),
f AS (SELECT a.doc_id, a.i, any_value(a.id) AS id, list(b.id ORDER BY b.i) AS run FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {lengths[0] - 1} GROUP BY a.doc_id, a.i),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_matches, coalesce(ls, '') AS licences
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c, string_agg(DISTINCT licence, ',' ORDER BY licence) AS ls FROM ({union}) GROUP BY doc_id) USING (doc_id)
"""
