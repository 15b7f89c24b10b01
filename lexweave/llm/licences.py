"""Licence scans by sentence rules: normalised sentences map to identifiers of known licence sentences, and a
document's identifier sequence is matched against ordered licence rules. DataFrame functions only, no shuffle.

A text is cut three times: at line ends and sentence ends, at sentence ends alone (for wrapped lines), and at paragraph
ends, copyright lines and sentence ends (for wrapped standard texts below a title). A rule holds if its identifiers
appear in its order in one of the sequences. A rule that is part of another licence's longer rule is not reported beside it (the
two clauses of BSD-2-Clause, where the third makes it BSD-3-Clause). Versions are part of the sentences.

Defined cases: a null or empty text has no sentence and no licence; a very long text is read whole; a repeated sentence counts
each time; repeated rows and null doc_ids stay rows of their own; of cuts with as many known sentences the first is shown;
an empty table gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: GNU licences (name, version, SPDX name, date of the version).
GNU = (
    (_GPL, "2", "GPL-2.0", "June 1991"), (_GPL, "3", "GPL-3.0", "29 June 2007"), (_LGPL, "2.1", "LGPL-2.1", "February 1999"),
    (_LGPL, "3", "LGPL-3.0", "29 June 2007"), (_AGPL, "3", "AGPL-3.0", "19 November 2007"),
)
#: Creative Commons codes and their long names.
CREATIVE = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Known licence sentences by identifier, each up to its first sentence end.
SENTENCES = [
    ("apache2-header", "Licensed under the Apache License, Version 2.0"),
    ("apache2-long-1", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-unless", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("apache-title", "Apache License"),
    ("apache2-version", "Version 2.0, January 2004"),
    ("apache2-heading", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache2-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl3-program", "This program is licensed under the GNU General Public License, version 3"),
    ("gnu-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("mit-release", "Released under the MIT License"),
    ("mit-licensed", "Licensed under the MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-title-paren", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("bsd-title", "BSD License"),
    ("bsd3-title", "BSD 3-Clause License"),
    ("bsd2-title", "BSD 2-Clause License"),
    ("bsd-header", "Licensed under the BSD 3-Clause License"),
    ("bsd2-header", "Licensed under the BSD 2-Clause License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl2-heading", "Mozilla Public License Version 2.0"),
    ("isc-header", "Released under the ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd0-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-header", "Released under CC0 1.0 Universal license"),
    ("cc0-heading", "CC0 1.0 Universal"),
    ("cc0-work", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and released it into the public domain"),
]
#: Fixed values: (licence, identifiers in order); a licence holds if one of its rules holds.
RULES = [
    ("Apache-2.0", ("apache2-header",)), ("Apache-2.0", ("apache2-long-1", "apache2-copy")), ("Apache-2.0", ("apache2-long-1", "apache2-unless", "apache2-see")),
    ("Apache-2.0", ("apache-title", "apache2-version", "apache2-terms")), ("Apache-2.0", ("apache2-heading", "apache2-terms")), ("GPL-3.0", ("gpl3-program",)),
    ("MIT", ("mit-release",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-title", "mit-grant", "mit-warranty")), ("MIT", ("mit-title-paren", "mit-grant")), ("MIT", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd3-title",)), ("BSD-3-Clause", ("bsd-header",)), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd2-title",)), ("BSD-2-Clause", ("bsd2-header",)), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-header",)), ("MPL-2.0", ("mpl2-heading",)), ("ISC", ("isc-header",)), ("ISC", ("isc-grant",)), ("0BSD", ("bsd0-grant",)),
    ("Zlib", ("zlib-asis", "zlib-liable", "zlib-grant")), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0-header",)), ("CC0-1.0", ("cc0-heading", "cc0-work")), ("CC0-1.0", ("cc0-work",)),
]
for _name, _version, _spdx, _date in GNU:
    _key = _spdx.lower()
    _modify = "is free software: you can redistribute it and/or modify it under the terms of the"
    for _kind in ("library", "program", "software"):
        SENTENCES += [
            (f"{_key}-later", f"This {_kind} {_modify} {_name} as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version"),
            (f"{_key}-only", f"This {_kind} {_modify} {_name} as published by the Free Software Foundation, version {_version} of the License"),
            (f"{_key}-only", f"This {_kind} {_modify} {_name} version {_version} as published by the Free Software Foundation"),
        ]
    SENTENCES += [
        (f"{_key}-header", f"This work is licensed under the {_name}, version {_version}"), (f"{_key}-heading", f"{_name} Version {_version}, {_date}"),
        (f"title-{_name.lower().replace(' ', '-')}", _name), (f"version-{_version}-{_date[-4:]}", f"Version {_version}, {_date}"),
    ]
    RULES += [
        (f"{_spdx}-or-later", (f"{_key}-later",)), (f"{_spdx}-only", (f"{_key}-only",)), (_spdx, (f"{_key}-header",)), (_spdx, (f"{_key}-heading", "gnu-verbatim")),
        (_spdx, (f"title-{_name.lower().replace(' ', '-')}", f"version-{_version}-{_date[-4:]}")),
    ]
for _code, _long in CREATIVE.items():
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        _key = f"cc-{_code.lower()}-{_version}"
        SENTENCES += [(_key, f"Licensed under CC {_code} {_version}"), (f"{_key}-long", f"This work is licensed under a Creative Commons {_long} {_version} {_kind} License")]
        RULES += [(f"CC-{_code}-{_version}", (_key,)), (f"CC-{_code}-{_version}", (f"{_key}-long",))]
for _spdx in sorted({name for name, _ in RULES}):
    SENTENCES.append((f"spdx-{_spdx.lower()}", f"SPDX-License-Identifier: {_spdx}"))
    RULES.append((_spdx, (f"spdx-{_spdx.lower()}",)))
#: Every rule has a sentence that holds one of these inside a word; texts without any, sentence signs aside, need no cutting.
ANCHORS = ("licen", "public", "redistribution", "permission")
#: Known sentences that go on after a blank line, by the words around it.
GOES_ON = (("subject to the following conditions", "the above copyright notice"), ("obtain a copy of the license at", "http"))
#: Rewritten before sentences are looked up: a version's full stop ends none, and any holder may be named.
VERSION = (r"\bv\.[ \n]+([0-9])", "v $1")
HOLDER = (r"neither the name of [a-z0-9 ]{1,100} nor the names of", "neither the name of the copyright holder nor the names of")


def normalise(sentence: str) -> str:
    kept = re.sub(r"[^a-z0-9.!?\n]+", " ", sentence.lower())
    kept = re.sub(VERSION[0], VERSION[1].replace("$", "\\"), kept)
    return kept.translate({ord(c): None for c in ".!?"}).strip()


KNOWN = {normalise(s): k for k, s in SENTENCES}
#: By rule: the other licences whose longer rules it is part of.
INSIDE = [sorted({other for other, more in RULES if other != name and len(more) > len(ids) and set(ids) <= set(more)}) for name, ids in RULES]


def _lined(normal: Column) -> Column:
    return F.regexp_replace(normal, r"[.!?]* *\n|[.!?]+ ", "|")


def _wrapped(normal: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normal, r" *\n[ \n]*", " "), r"[.!?]+ ", "|")


def _paragraphs(normal: Column) -> Column:
    marked = F.regexp_replace(normal, r"(?m)^ *copyright( c)? (\d{4}|yyyy|year)\b.*$", "\n\n")
    marked = F.regexp_replace(marked, r"\n *\n[ \n]*", "|")
    for before, after in GOES_ON:
        marked = F.regexp_replace(marked, "(" + before.replace(" ", "[ \\n]+") + r")[ \n]*\|[ \n]*(" + after.replace(" ", "[ \\n]+") + ")", "$1 $2")
    return F.regexp_replace(F.regexp_replace(marked, r" *\n *", " "), r"[.!?]+ ", "|")


def _identifiers(marked: Column) -> Column:
    pieces = F.split(F.regexp_replace(marked, *HOLDER), r"\|")
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.filter(F.transform(pieces, lambda p: F.try_element_at(known, F.trim(F.translate(p, ".!?", "")))), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_sentences (known ones), sentence_ids, licences and n_licences."""
    near = reduce(lambda a, b: a | b, [F.translate(F.lower("text"), ".!?", "").contains(a) for a in ANCHORS])
    normal = F.regexp_replace(F.regexp_replace(F.lower(F.col("text")), r"[^a-z0-9.!?\n]+", " "), *VERSION)
    empty = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(near, normal).alias("normal"))
    cuts = {"lined": _lined, "wrapped": _wrapped, "paragraphs": _paragraphs}
    rows = rows.select("doc_id", *[F.when(F.col("normal").isNotNull(), _identifiers(cut(F.col("normal")))).otherwise(empty).alias(name) for name, cut in cuts.items()])

    def holds(ids: Column, rule: Column) -> Column:
        return F.aggregate(ids, F.lit(0), lambda at, x: F.when((at < F.size(rule)) & (F.get(rule, at) == x), at + 1).otherwise(at)) == F.size(rule)

    listed = lambda values: F.array(*map(F.lit, values)) if values else empty
    rules = F.array(*[F.struct(F.lit(name).alias("name"), listed(ids).alias("ids"), listed(inside).alias("inside")) for (name, ids), inside in zip(RULES, INSIDE, strict=True)])
    found = F.filter(rules, lambda r: reduce(lambda a, b: a | b, [holds(F.col(c), r.getField("ids")) for c in cuts]))
    most = F.greatest(*[F.size(c) for c in cuts])
    rows = rows.withColumn("found", F.when(most > 0, found))
    names = F.transform("found", lambda r: r.getField("name"))
    own = F.filter("found", lambda r: ~F.arrays_overlap(r.getField("inside"), names))
    licences = F.coalesce(F.array_sort(F.array_distinct(F.transform(own, lambda r: r.getField("name")))), empty)
    more = F.when(F.size("lined") == most, F.col("lined")).when(F.size("wrapped") == most, F.col("wrapped")).otherwise(F.col("paragraphs"))
    rows = rows.select("doc_id", more.alias("ids"), licences.alias("names"))
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("names", ",").alias("licences"), F.size("names").cast("bigint").alias("n_licences"),
    )
