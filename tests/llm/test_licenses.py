"""License scans against regular expressions, and their SQL against the query."""

import random
import re

import pytest

from storyloom.llm import licenses, queries
from tests.compare import compare, connect


def accepted(markup, words):
    """Leftmost spans, each as long as it can be, by trying every place with the wording as a regular expression."""
    form, out = re.compile(licenses.pattern(markup)), []
    longest = lambda i: max((j for j in range(i + 1, len(words) + 1)
                             if form.fullmatch(" " + "".join(w + " " for w in words[i:j]))), default=None)
    i = 0
    while i < len(words):
        j = longest(i)
        if j:
            out.append((i, j))
        i = j or i + 1
    return out


@pytest.mark.parametrize("markup", [
    "a b", "a <<optional>> b <<end>> c", "a <<any 0-2>> b", "<<any 1-2>> a <<optional>> b <<optional>> c <<end>> <<end>>",
    "a <<optional>> <<any 1-1>> a <<end>> b <<any 0-3>>", "<<optional>> a <<end>> <<optional>> b <<end>> a b <<any 2-3>> c"])
def test_automaton_accepts_what_the_wording_says(markup):
    rng = random.Random(markup)
    template = licenses.Template(markup)
    for _ in range(150):
        words = rng.choices("abcx", k=rng.randint(0, 14))
        got = template.spans([w.encode() for w in words])
        assert bool(got) == bool(re.search(licenses.pattern(markup), " " + "".join(w + " " for w in words)))
        assert got == accepted(markup, words), words


def test_sets_are_made_anew(monkeypatch):
    monkeypatch.setattr(licenses, "SETS", 2)
    template = licenses.Template("a <<any 0-2>> b <<optional>> c <<end>> d")
    for words in ("a x b d", "a b c d", "a a b c d d", "b d"):
        assert template.spans(words.encode().split()) == accepted("a <<any 0-2>> b <<optional>> c <<end>> d", words.split())


@pytest.mark.parametrize("bad", ["a <<optional>> b", "a <<end>>", "<<optional>> a <<end>>", "A b", "a <<any 3-1>>", "a << b", ""])
def test_templates_that_do_not_compile(bad):
    with pytest.raises(ValueError):
        licenses.Template(bad)


MIT = """Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_texts_and_odd_rows(spark):
    texts = [MIT, MIT.replace("free of charge", "for a fee"), "x Released under the MIT License. MIT LICENSE", None, "", " .-\n", "Apache  license!",
             "GNU General Public License and the Apache License", "mit licenses", "émit license", "Licensed under CC BY-NC 4.0.", "cc-by cc_by",
             "Copyright 2001 by Somebody Else, all rights reserved", "w " * 300_000 + "cc by"]
    rows = [(i, t, "clash", 2.0) for i, t in enumerate(texts)] + [(6, texts[6], None, None), (None, "mit license", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in licenses.scan(docs, ["doc_id"]).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    none = (0, 0, None, None, "", "", 0.0)
    assert [r[1:] for r in got[3:6]] == [none] * 3
    assert got[0][6] == "mit-text" and got[0][7] == 1.0 and got[1][6] == ""
    assert got[2][1:] == (8, 2, 4, 6, "mit", "mit,mit-notice", 1.0)
    assert got[6] == got[7] == (6, 2, 1, 0, 0, "apache", "apache", 2 / 8)
    assert got[8][1:6] == (8, 2, 0, 6, "apache,gpl") and got[9][1:3] == (2, 0) and got[10][1:3] == (2, 0)
    assert got[11][5:8] == ("cc-by", "cc-by,cc-by-nc", 1.0) and got[12][2:5] == (2, 0, 2)
    assert got[13][6] == "all-rights-reserved" and got[14][1:5] == (300_002, 1, 300_000, 300_000) and got[15][0] is None
    assert licenses.scan(docs.where("false"), ["doc_id"]).count() == 0
    spans = licenses.scan(docs.where("doc_id = 2"), ["doc_id"], with_spans=True).first().spans
    assert [tuple(s) for s in spans] == [(1, 6, "mit-notice"), (4, 6, "mit"), (6, 8, "mit")]
    with pytest.raises(ValueError):
        licenses.scan(docs, ["labels"])


def test_query_equals_its_sql(spark):
    root = "/root/testdata/sf0.001"
    problem, n = compare(spark, connect(root), "op12_licenses", queries.op12_licenses, queries.SQL["op12_licenses"], root)
    assert problem is None and n > 0
