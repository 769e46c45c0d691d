"""Licence scans by sentence rules.

A text is cut into sentences, each normalised (lower case, all but letters and digits
one blank) and looked up among known licence sentences, which gives an identifier; any
other sentence is an unknown one. A rule is an ordered sequence of identifiers of one
licence; it holds where they follow each other in the text with at most ``GAP`` unknown
sentences between two of them. Rules are tried in their order, longer ones of a licence
first.

Texts are cut twice: into paragraphs and their sentences, with line ends as blanks, for
sentences that run over lines; and with line ends as cuts, for notices on a line of
their own. Beforehand comment signs and list marks at line starts go, and copyright lines
become cuts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Sentences of public licences, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "Licensed under the BSD License",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the License)",
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-work-3": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl-work-3": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense-public": "This is free and unencumbered software released into the public domain",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided as-is, without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4-short": "Licensed under CC BY 4.0",
    "cc-by-sa-4-short": "Licensed under CC BY-SA 4.0",
    "cc0-short": "Licensed under CC0 1.0",
    "bsd-endorse-org": "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-url-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "lgpl-redistribute-21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-redistribute-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "epl-terms-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-21-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-mpl-2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mit-or-apache": "SPDX-License-Identifier: MIT OR Apache-2.0",
    "spdx-apache-or-mit": "SPDX-License-Identifier: Apache-2.0 OR MIT",
}
# Ordered rules, the licence and its sequence of identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-org"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-hope", "gpl-details"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-compliance", "apache-copy-url"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-compliance", "apache-copy-url-s"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute-21"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute-3"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute-3"]),
    ("GPL-2.0-only", ["gpl-redistribute-only-2"]),
    ("EPL-2.0", ["epl-terms-2"]),
    ("BSL-1.0", ["boost-distributed"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy-s"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Unlicense", ["unlicense-public", "unlicense-free"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-spdx"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-spdx"]),
    ("BSD-3-Clause", ["bsd-licensed"]),
    ("GPL-2.0-only", ["gpl-work-2"]),
    ("GPL-3.0-only", ["gpl-work-3"]),
    ("LGPL-3.0-only", ["lgpl-work-3"]),
    ("AGPL-3.0-only", ["agpl-work-3"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC0-1.0", ["cc0-short"]),
    ("BSD-2-Clause", ["spdx-bsd-2"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
    ("GPL-2.0-only", ["spdx-gpl-2"]),
    ("GPL-2.0-or-later", ["spdx-gpl-2-later"]),
    ("GPL-3.0-only", ["spdx-gpl-3"]),
    ("GPL-3.0-or-later", ["spdx-gpl-3-later"]),
    ("LGPL-2.1-or-later", ["spdx-lgpl-21-later"]),
    ("MPL-2.0", ["spdx-mpl-2"]),
    ("ISC", ["spdx-isc"]),
    ("MIT", ["spdx-mit-or-apache"]),
    ("Apache-2.0", ["spdx-mit-or-apache"]),
    ("Apache-2.0", ["spdx-apache-or-mit"]),
    ("MIT", ["spdx-apache-or-mit"]),
]
#: Unknown sentences that may stand between two of a rule.
GAP = 3
#: Comment signs and list marks at a line's start, which go.
MARKS = r"(^|\n)[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+|>+)[ \t]*)?(?:(?:[0-9]{1,2}|[a-z])[.)][ \t]+|\([0-9a-z]{1,2}\)[ \t]+)?"
#: Copyright lines (in lower case), which cut; so do empty lines and rules of signs.
OWNERS = r"(^|\n)(?:copyright[ \t]+(?:\(c\)|©|<year>|\[yyyy\]|[0-9]{4})|\(c\)[ \t]*(?:copyright|[0-9]{4})|©|all rights reserved)[^\n]*"
#: Where sentences end: stops followed by white space or the end, and empty lines; with line ends as cuts, those too.
STOPS, STOPS_OR_LINES = r"[.!?:;]+(?:[ \t\n\r]+|$)|\n[ \t\r*#=/-]*\n\s*", r"[.!?:;]*(?:[.!?:;][ \t\r]+|[.!?:;]$|\n)"
UNKNOWN = "?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def _parts(sentence: str) -> list[str]:
    """A licence sentence as texts are cut: at its own stops."""
    return [n for s in re.split(STOPS, sentence) if (n := normalised(s))]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier. A sentence with stops within it is known by its parts in order."""
    return {part: f"{name}.{i}" for name, s in SENTENCES.items() for i, part in enumerate(_parts(s))}


def rules() -> list[tuple[str, str, list[str]]]:
    """(licence, regular expression, those of other licences' rules that begin with this one).

    The first is the rule's identifiers between bars, with some unknown sentences. A rule
    does not hold where one of the others does, as it is then that one's beginning.
    """
    known, between = known_sentences(), f"[|](?:[{UNKNOWN}][|]){{0,{GAP}}}"

    def pattern(names: list[str]) -> str:
        return "[|]" + between.join(known[p].replace(".", "[.]") for name in names for p in _parts(SENTENCES[name])) + "[|]"

    return [(licence, pattern(names), [pattern(other) for of, other in RULES if of != licence and len(other) > len(names) and other[: len(names)] == names]) for licence, names in RULES]


def _clean(text: Column) -> Column:
    """Lower case, without marks at line starts, copyright lines empty."""
    bare = F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, "$1")
    return F.regexp_replace(bare, OWNERS, "$1\n\n")


def _sequence(clean: Column, stops: str) -> Column:
    """The identifiers of the text's sentences between bars; without a known one, only two bars."""
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    sentences = F.filter(F.transform(F.split(clean, stops, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")
    found = F.transform(sentences, lambda s: F.coalesce(F.element_at(known, s), F.lit(UNKNOWN)))
    joined = F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))
    return F.regexp_replace(joined, f"^(?:[|][{UNKNOWN}])*[|]$|^[|][|]$", "||")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, licences, primary) for each row; docs needs doc_id and text.

    n_known: known sentences, as cut in paragraphs or in lines, whichever finds more. licences: names of the rules that hold, in the rules' order, joined by commas,
    empty if there are none; primary: the first of them, or null. A null or empty text
    has none. Rows that repeat give a row each; other columns are not used; an empty
    table gives an empty table.
    """
    clean = docs.select("doc_id", _clean(F.coalesce("text", F.lit(""))).alias("clean"))
    found = clean.select("doc_id", _sequence(F.col("clean"), STOPS).alias("a"), _sequence(F.col("clean"), STOPS_OR_LINES).alias("b"))
    none = (F.col("a") == "||") & (F.col("b") == "||")

    def met(p: str) -> Column:
        return F.rlike("a", F.lit(p)) | F.rlike("b", F.lit(p))

    holds = [F.when(reduce(lambda c, q: c & ~met(q), longer, met(p)), F.lit(name)) for name, p, longer in rules()]
    names = F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*holds))))
    known = [F.size(F.filter(F.split(c, "[|]"), lambda s: (s != "") & (s != UNKNOWN))) for c in "ab"]
    named = found.select("doc_id", F.when(none, 0).otherwise(F.greatest(*known)).cast("long").alias("n_known"), names.alias("names"))
    return named.select("doc_id", "n_known", F.array_join("names", ",").alias("licences"), F.get("names", F.lit(0)).alias("primary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in known_sentences().items()) + "}"

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def sequence(stops: str) -> str:
        clean = f"list_filter(list_transform(string_split_regex(t, {quoted(stops)}), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ')), lambda s: s <> '')"
        joined = f"'|' || array_to_string(list_transform({clean}, lambda s: coalesce(k[s], '{UNKNOWN}')), '|') || '|'"
        return f"regexp_replace({joined}, '^(?:[|][{UNKNOWN}])*[|]$|^[|][|]$', '||')"

    def met(p: str) -> str:
        return f"(regexp_matches(a, {quoted(p)}) OR regexp_matches(b, {quoted(p)}))"

    holds = ", ".join(f"CASE WHEN {' AND NOT '.join(map(met, [p, *longer]))} THEN '{name}' END" for name, p, longer in rules())
    n = f"len(list_filter(string_split({{0}}, '|'), lambda s: s <> '' AND s <> '{UNKNOWN}'))"
    bare = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {quoted(MARKS)}, '\\1', 'g')"
    return f"""
WITH d AS (SELECT doc_id, regexp_replace({bare}, {quoted(OWNERS)}, '\\1' || chr(10) || chr(10), 'g') AS t, {known} AS k FROM documents),
s AS (SELECT doc_id, {sequence(STOPS)} AS a, {sequence(STOPS_OR_LINES)} AS b FROM d),
h AS (SELECT doc_id, a, b, list_filter([{holds}], lambda x: x IS NOT NULL) AS all_names FROM s),
n AS (SELECT *, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) AS names FROM h)
SELECT doc_id, (CASE WHEN a = '||' AND b = '||' THEN 0 ELSE greatest({n.format("a")}, {n.format("b")}) END)::BIGINT AS n_known,
       array_to_string(names, ',') AS licences, names[1] AS primary
FROM n
"""


SQL = _sql()
