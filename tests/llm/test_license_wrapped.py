import textwrap

import pytest

from tidelog.llm import license_scan as ls

PREFIXES = ["", "# ", "// ", " * ", ";; ", "-- "]
HEADERS = [
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"), (("gpl3-later@program", "gpl-no-warranty"), "GPL-3.0-or-later"), (("gpl2-only@program", "gpl-no-warranty"), "GPL-2.0-only"),
    (("gpl2-only@named@program",), "GPL-2.0-only"), (("gpl2-later@program",), "GPL-2.0-or-later"), (("lgpl2.1-later@library", "lgpl-copy"), "LGPL-2.1-or-later"), (("agpl3-later@program",), "AGPL-3.0-or-later"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"), (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("apache-ref-the", "apache-use", "apache-as-is"), "Apache-2.0"), (("mpl-form", "mpl-obtain"), "MPL-2.0"), (("isc-grant", "isc-as-is"), "ISC"), (("bsl-grant",), "BSL-1.0"), (("unlicense",), "Unlicense"), (("cc0-waived",), "CC0-1.0"),
]


def wrapped(names, prefix, end):
    body = []
    for n in names:
        body += [*textwrap.wrap(ls.SENTENCES[n], 60), ""]
    return end.join(["int x", *((prefix + line).rstrip() for line in body), "x = 1"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_headers(spark, end):
    cases = [(wrapped(names, p, end), ",".join(n.partition("@")[0] for n in names), licence) for names, licence in HEADERS for p in PREFIXES]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.row_.doc_id: (r.sentence_ids, r.license) for r in ls.scan(docs).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_what_is_no_wrapped_sentence(spark):
    texts = ["Released under\n\nthe MIT License.", "Released under.\nthe MIT License.", "Released under\n#\nthe MIT License.", "It is Released under\nthe MIT License.", "Released under\nthe MIT License of old"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.license for r in ls.scan(docs).collect()] == [None] * len(texts)


MIT = """MIT License

Copyright (c) 2020 Some One

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
GPL3 = """foo is a tool.  This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 3 of the License, or (at your
option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_published_texts(spark):
    texts = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL2_ONLY, "GPL-2.0-only"), (GPL3, "GPL-3.0-or-later"), (MPL, "MPL-2.0")]
    forms = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "\n".join(textwrap.wrap(" ".join(t.split()), 72)), lambda t: "\n".join("// " + x for x in t.split("\n"))]
    cases = [(f(t), name) for t, name in texts for f in forms]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.row_.doc_id: r.license for r in ls.scan(docs).collect()} == {i: n for i, (_, n) in enumerate(cases)}
