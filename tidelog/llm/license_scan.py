"""Licence scan by sentence rules.

The sentences of a text are normalised and mapped to the identifiers of the known licence sentences that they equal, and the
sequence of identifiers is matched against ordered licence rules. A rule is a list of identifiers that must follow one another,
with other known sentences between them allowed; where several rules fit, the one listed first names the licence.

Normalised text has lower-case words only. Line ends, comment signs and punctuation within a known sentence don't matter, so
wrapped texts and texts joined to one line give the same identifiers. A sentence of ``LONG`` words or more is known wherever its
words stand in a row, even behind a heading that has no full stop; a shorter one must stand between sentence or line ends.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed

#: Words from which on a sentence is known in the middle of others.
LONG = 9


def _gnu(name: str, version: str, subject: str) -> dict[str, str]:
    """The notices of one GNU licence: any later version, with and without "either", and that version only, in both wordings."""
    head = f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}"
    return {
        "later": f"{head} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
        "later@plain": f"{head} as published by the Free Software Foundation; version {version} of the License, or (at your option) any later version.",
        "only": f"{head} as published by the Free Software Foundation; version {version} of the License.",
        "only@named": f"{head} version {version} as published by the Free Software Foundation.",
    }


#: Short name, full name and version of the GNU licences.
GNU = (
    ("GPL", "General Public License", "2"),
    ("GPL", "General Public License", "3"),
    ("LGPL", "Lesser General Public License", "2.1"),
    ("LGPL", "Lesser General Public License", "3"),
    ("LGPL", "Library General Public License", "2"),
    ("AGPL", "Affero General Public License", "3"),
)

#: Sentences of public licence texts and notices, by identifier; what follows an @ tells wordings apart.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref-the": "Licensed under the Apache License, Version 2.0 (the \"License\").",
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mit-released": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsl-ref": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-waived": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "cc0": "Licensed under CC0 1.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "rights-reserved": "All rights reserved.",
} | {f"{short.lower()}{version}-{form}@{subject}": s for short, name, version in GNU for subject in ("program", "library", "file") for form, s in _gnu(name, version, subject).items()}

#: (licence, identifiers in order); the first that fits names the licence.
RULES = (
    *((f"{short}-{version if '.' in version else version + '.0'}-{kind}", (f"{short.lower()}{version}-{form}",)) for short, _, version in GNU for form, kind in (("later", "or-later"), ("only", "only"))),
    ("GPL-3.0", ("gpl3-work",)),
    ("Apache-2.0", ("apache-ref-the", "apache-use", "apache-as-is")),
    ("Apache-2.0", ("apache-ref-the",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MPL-2.0", ("mpl-form",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source")),
    ("BSL-1.0", ("bsl-ref",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("proprietary", ("rights-reserved",)),
)

SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: Where a sentence ends whatever follows.
CUT = f"[.!?:;]+(?:{SPACE}+|\\z)"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in sentence)).strip(" ")


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier."""
    return {normalised(s): name.partition("@")[0] for name, s in sentences.items()}


def anchors(pieces: dict[str, str]) -> list[str]:
    """Few words such that every known piece holds one of them (greedy): texts without any hold no known sentence."""
    left, chosen = {p: set(p.split()) for p in pieces}, []
    usual = Counter(w for ws in left.values() for w in ws if len(w) > 4)
    while left:
        best = max(sorted({w for ws in left.values() for w in ws}), key=lambda w: (len(w) > 4, sum(w in ws for ws in left.values()), len(w), usual[w]))
        chosen.append(best)
        left = {p: ws for p, ws in left.items() if best not in ws}
    return sorted(chosen)


def _lines(text: Column) -> Column:
    """Normalised words, a line end between lines and an empty line wherever a sentence ends; comment signs vanish."""
    bare = F.regexp_replace(text, "(^|\\n)[ \\t]*;+", "$1")  # signs of a comment, no end of a sentence
    plain = F.regexp_replace(ascii_lower(F.regexp_replace(bare, CUT, "\n\n")), "[^a-z0-9\\n]+", " ")
    return F.trim(F.regexp_replace(plain, " ?\\n ?", "\n"))


def _pattern(pieces: dict[str, str]) -> str:
    """Any known piece; longer ones first."""
    order = sorted(pieces, key=lambda p: (-len(p), p))
    long = "|".join(p.replace(" ", "[ \\n]+") for p in order if p.count(" ") + 1 >= LONG)
    short = "|".join(p.replace(" ", "[ \\n]") for p in order if p.count(" ") + 1 < LONG)
    return "|".join(x for x in (f"(?<![a-z0-9])(?:{long})(?![a-z0-9])" if long else "", f"(?<![^\\n])(?:{short})(?![^\\n])" if short else "") if x)


def _sequence(text: Column, pieces: dict[str, str]) -> Column:
    """Comma-joined identifiers of the known sentences of a text, in order; null where there's none."""
    table = F.create_map(*[F.lit(x) for pair in sorted(pieces.items()) for x in pair])
    found = F.regexp_extract_all(_lines(text), F.lit(_pattern(pieces)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, "[ \\n]+", " ")))
    some = F.regexp_like(text, F.lit("(?i)" + "|".join(anchors(pieces))))
    return F.when(some, F.nullif(F.array_join(ids, ","), F.lit("")))


def _fits(ids: tuple[str, ...]) -> str:
    return "(?:^|,)" + ",(?:[^,]+,)*".join(map(re.escape, ids)) + "(?:,|$)"


def scan(docs: DataFrame, text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """All columns of docs in one struct ``row_``, with sentence_ids (comma-joined, null if none) and license (null if none).

    Null and empty texts have no licence. Repeated rows are scanned each; an empty table gives an empty result. No shuffle.
    """
    found = docs.select(packed(docs), _sequence(F.col(f"`{text_col}`"), known(sentences)).alias("sentence_ids"))
    licence = F.coalesce(*[F.when(F.regexp_like("sentence_ids", F.lit(_fits(ids))), F.lit(name)) for name, ids in rules])
    return found.withColumn("license", F.when(F.col("sentence_ids").isNotNull(), licence))


def oracle(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """For DuckDB, whose patterns can't look around: every separator is doubled, so that neighbours don't share one."""
    pieces = known(sentences)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(quote(x) for x in pieces.values())
    keys = ", ".join(quote(x) for x in pieces)
    order = sorted(pieces, key=lambda p: (-len(p), p))
    long = "|".join(p.replace(" ", "[ \\n]+") for p in order if p.count(" ") + 1 >= LONG)
    short = "|".join(p.replace(" ", "(?:  |\\n\\n)") for p in order if p.count(" ") + 1 < LONG)
    pattern = f"(?:[ \\n](?:{long})[ \\n])|(?:\\n(?:{short})\\n)"
    cases = " ".join(f"WHEN regexp_matches(sentence_ids, {quote(_fits(ids).replace(chr(92) + '-', '-'))}) THEN {quote(name)}" for name, ids in rules)
    cut = CUT.replace("\\x0B", "\\x0b")
    low = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|\\n)[ \\t]*;+', '\\1', 'g'), {quote(cut)}, chr(10) || chr(10), 'g') AS t FROM documents),
    b AS (SELECT doc_id, trim(regexp_replace(regexp_replace({low}, '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ') AS t FROM a),
    c AS (SELECT doc_id, chr(10) || replace(replace(t, ' ', '  '), chr(10), chr(10) || chr(10)) || chr(10) AS t FROM b),
    ids AS (SELECT doc_id, nullif(array_to_string(list_transform(regexp_extract_all(t, {quote(pattern)}), lambda s: list_extract([{names}], list_position([{keys}], trim(regexp_replace(s, '[ \\n]+', ' ', 'g'))))), ','), '') AS sentence_ids FROM c)
    SELECT doc_id, sentence_ids, CASE {cases} ELSE NULL END AS license FROM ids"""
