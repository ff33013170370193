import re
import textwrap

from scriptorium.llm import licenses as L


def said(spark, texts):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    return [(r["n_known"], r["licenses"]) for r in L.scan_licenses(df, keep=["doc_id"]).orderBy("doc_id").collect()]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


def test_rules_are_ordered_and_sequences_matter(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    texts = [MIT, MIT.splitlines()[0], "text\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0. All rights reserved.", bsd, "Released under the MIT License. Released under the MIT License."]
    assert said(spark, texts) == [(3, "MIT"), (1, "MIT-like"), (1, "MIT"), (2, "CC-BY-NC-4.0,all-rights-reserved"), (2, ""), (2, "MIT")]


def test_other_sentences_between_break_a_sequence(spark):
    a, b, c = MIT.splitlines()
    assert said(spark, [f"{a}\nSomething else.\n{b}\n{c}"]) == [(3, "MIT-like")]


def test_odd_rows(spark, odd_docs):
    out = L.scan_licenses(odd_docs)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.columns[-3:] == ["n_known_", "sequence", "licenses"]
    rows = out.collect()
    assert len(rows) == 11 and all(r["n_known_"] == 0 and r["licenses"] == "" for r in rows)
    assert {r["doc_id"]: r["sequence"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {3: ",", 4: ",", 5: ",", 6: ",?,"}
    assert L.scan_licenses(odd_docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, odd_docs):
    plan = L.scan_licenses(odd_docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Pandas" not in plan


# The texts as SPDX has them, one line for each paragraph.
SPDX_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
SPDX_BSD = """Copyright (c) <year> <owner>.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
SPDX_GPL = """Copyright (C) <year> <name of author>

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def wrapped(text, width, indent=""):
    return "\n".join(textwrap.fill(line, width, initial_indent=indent, subsequent_indent=indent) for line in text.split("\n"))


def test_full_texts_wrapped_and_unwrapped(spark):
    for text, want in ((SPDX_MIT, (3, "MIT")), (SPDX_BSD, (4, "BSD-3-Clause")), (SPDX_BSD.replace("3. Neither", "3. Not"), (3, "BSD-2-Clause")), (SPDX_GPL, (2, "GPL-3.0-or-later"))):
        forms = [text, text.replace("\n", "\r\n"), *[wrapped(text, w) for w in (30, 47, 72, 78, 79, 80)], wrapped(text, 76, " * "), wrapped(text, 76, "# ")]
        assert said(spark, forms) == [want] * len(forms)
    bullets = re.sub("[0-9][.] ", "* ", SPDX_BSD)
    only = SPDX_GPL.replace("either version 3 of the License, or (at your option) any later version", "version 3")
    named = SPDX_BSD.replace("the copyright holder", "Example Widgets Inc.")
    assert said(spark, [wrapped(bullets, 70), wrapped(named, 70), wrapped(only, 70)]) == [(4, "BSD-3-Clause"), (4, "BSD-3-Clause"), (2, "GPL-3.0-only")]


def test_only_whole_sentences_are_joined(spark):
    texts = ["All rights\nreserved.", "Not all rights\nreserved.", "All rights.\nReserved.", "All rights\n\nreserved.", "Released under the\nMIT License or another", "x " + "- " * 50000 + "all rights" + " " * 50000 + "reserved"]
    assert said(spark, texts) == [(1, "all-rights-reserved"), *[(0, "")] * 5]


def test_further_notices(spark):
    gpl2 = SPDX_GPL.replace("version 3", "version 2")
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED"
    out = said(spark, [gpl2, lgpl, mpl, isc, isc.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")])
    assert [x for _, x in out] == ["GPL-2.0-or-later", "LGPL-2.1-or-later", "MPL-2.0", "ISC", "0BSD"]
