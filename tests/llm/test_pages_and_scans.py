import random

import pytest
from plain import AWKWARD, base_spans, documents
from pyspark.sql import functions as F

from gridwise.llm import html_text, licenses, secret_scan

PAGES = {
    None: "", "": "", "just text": "just text", "<p>one<p>two": "one two", "<!-- open <p>x": "",
    "<body><nav><a href='/'>Home</a> <a href='/b'>All the other pages</a></nav><article><h1>Head &amp; line</h1><p>A <b>b</b>old"
    "\n start.<br>Next&nbsp;line &lt;ok&gt;</p></article><footer>&copy; us</footer></body>": "Head & line A bold start. Next line <ok>",
    "<body><div class='cookie-notice'>We use cookies on this site, accept them all please</div><div id=main><h2>T</h2><p>First "
    "paragraph of the text, which is long enough.</p><p>Second one with a <a href=x>link</a> in it.</p></div><div class='sidebar'>"
    "<ul><li><a>x</a><li><a>y</a></ul></div></body>":
        "T First paragraph of the text, which is long enough. Second one with a link in it.",
    "<body><article class='post with-sidebar'><p>Body text here.</p><div class='ad'>Buy now</div><form>Name <input></form>"
    "<div class=comments><p>A very long comment that is longer than the text itself, by far.</p></div></article>"
    "<section id='comments'><p>Another long comment, longer than anything else on the page.</p></section></body>": "Body text here.",
    "<article><script>var a = '</p><p>no</p>';</script><style>p{}</style><p title='a>b'>yes</article>": "yes",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>": "a b c d e",
    "<article><p>unclosed <b>bold<p>next</article>": "unclosed bold next",
    "<body hidden><p>x</p></body>": "x",
}


def test_main_text(spark):
    rows = [(i, h, "old", "clash") for i, h in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, url string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == dict(enumerate(PAGES.values()))
    assert html_text.extract_text(pages.limit(0)).columns == ["page_id", "url", "text"]


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    body = " ".join(f"w{i}" for i in range(50_000))
    assert html_text.main_text(f"<article><p>{body}</p></article>") == body
    assert html_text.main_text("<a <b <c 'x \"" * 2000) is not None


def test_licenses(spark):
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and" \
        " associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation" \
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit" \
        " persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and" \
        " this permission notice shall be included in all copies or\nsubstantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED" \
        " \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY," \
        " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    cases = {
        None: ("", "", ""), "": ("", "", ""), "Nothing here. Licensed to nobody.": ("", "", ""),
        "Text.\nReleased under the MIT License.\nMore text.": ("mit-ref", "MIT", ""),
        "Heading without a mark\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.": ("cc-by-nc-ref,cc-by-nc-ref", "CC-BY-NC-4.0", ""),
        mit: ("mit-title,mit-grant,mit-notice,as-is", "MIT", ""),
        "All rights reserved. Licensed under the Apache License, Version 2.0.": ("reserved,apache-ref", "Apache-2.0", "reserved"),
    }
    rows = [(i, t, "x") for i, t in enumerate(cases)]
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).orderBy("doc_id").collect()
    assert [(r.sentence_ids, r.licenses, r.left_over) for r in got] == list(cases.values())
    assert all(any(s in words for s in licenses.STEMS) for words in licenses.SENTENCES.values())
    assert licenses.recognise(documents(spark)).count() == len(AWKWARD)


def spans_of(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    found = secret_scan.scan(df).orderBy("doc_id").select(
        secret_scan.joined(F.col("base_spans")).alias("base"), secret_scan.joined(F.col("spans")).alias("spans"),
        F.when(F.col("text").isNotNull(), secret_scan.masked(F.col("text"), F.col("spans"))).alias("masked"),
    )
    return found.collect()


def test_base_spans(spark):
    rows = [r[1] for r in AWKWARD] + [
        'password="hunter2hunter2" token:short token = "' + "0a1b" * 10 + '"', "secret=token:abcdefgh12", "AKIAAKIA12345678901 AKIA1",
        "Api_Key = 'ÀAbcdefghij'", "password=token=abcdefgh1", "e" * 31 + " " + "f" * 32, "deadbeef" * 5 + "X" + "deadbeef" * 4,
        "\U0001f600 passwd:  abcdefghi", "API_KEY:abcdefgh,api_key=zzzzzzzz\napikey = yyyyyyyyy", "x" * 5000 + " token=12345678",
    ]
    got = spans_of(spark, rows)
    assert [r.base for r in got] == [",".join(base_spans(t)) for t in rows]
    for text, r in zip(rows, got):
        kept = text
        for span in reversed([s.split(":") for s in r.spans.split(",") if s]):
            if "\0" not in (kept or "")[int(span[1]) : int(span[2])]:
                kept = kept[: int(span[1])] + "\0" + kept[int(span[2]) :]
        if text and r.base.count(",") == 0:
            assert r.masked == kept.replace("\0", "[SECRET]")


def test_random_runs_and_structured_ones(spark):
    rng = random.Random(3)
    letters = secret_scan.DIGITS + secret_scan.UPPER + secret_scan.LOWER
    random_runs = ["key " + "".join(rng.choice(letters) for _ in range(40)) + " end" for _ in range(60)]
    parts = ["alpha", "beta2", "gamma", "release", "v12", "2020", "notes"]
    structured = ["see " + "-".join(rng.choice(parts) for _ in range(8)) + " there" for _ in range(60)]
    plain = ["ordinary words only, nothing to be seen here at all", "averylongwordwithoutanydigitsinitwhatsoever", "1" * 40 + " 12345678901234567890123"]
    got = spans_of(spark, [*random_runs, *structured, *plain])
    hits = ["random" in r.spans for r in got]
    assert sum(hits[:60]) >= 54 and not any(hits[60:])
    assert got[hits.index(True)].masked == "key [SECRET] end"


def test_false_discovery_limit():
    unit = secret_scan.BINS_PER_UNIT
    # Ten runs in all, five of them far out: the limit lies where 5 % of what is rejected may be random.
    limit = secret_scan.structured_from({"s": {0: 5, 400: 5}})["s"]
    assert limit * 1.0 / unit >= 3.68 and 0 < limit <= 400  # exp(-3.69) = 0.05 * 5 / 10
    assert secret_scan.structured_from({"s": {0: 5}})["s"] > 0


def test_scan_of_nothing(spark):
    assert secret_scan.scan(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "abc"])
def test_digest_of_no_spans(spark, text):
    row = spans_of(spark, [text])[0]
    assert (row.base, row.spans) == ("", "")


def test_licenses_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, licenses string")
    assert licenses.recognise(none).count() == 0


def test_licenses_between_very_long_lines(spark):
    text = "word " * 60_000 + "\nReleased under the MIT License.\n" + "x y " * 60_000 + "\nmore\n"
    row = licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.sentence_ids, row.licenses) == ("mit-ref", "MIT")
