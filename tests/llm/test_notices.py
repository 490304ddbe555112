"""Standard notices as they stand in files: wrapped, with empty lines, in comments."""

import textwrap

import pytest

from gridwise.llm import licenses

N = licenses.NOTICES
MIT = [N["mit-title"], "Copyright (c) 2020 Somebody", N["mit-grant"], N["mit-notice"], N["as-is"] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
BSD = "\n".join([f"1. {N['bsd-source']}", f"2. {N['bsd-binary']}"])
FULL = {
    "Apache-2.0": ["Copyright 2020 Somebody", N["apache-ref-you"] + " " + N["apache-copy"], "Unless required by applicable law or agreed to"
                   " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."],
    "GPL-3.0-or-later": [N["gpl-free"], N["gpl-hope"] + " See the GNU General Public License for more details."],
    "GPL-2.0-or-later": [N["gpl2-free"], N["gpl-hope"] + " See the GNU General Public License for more details."],
    "MPL-2.0": [N["mpl-terms"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "MIT": MIT,
    "BSD-3-or-2-Clause": ["Copyright (c) 2020, Somebody", N["bsd-use"], BSD],
    "ISC": ["Copyright (c) 2020 Somebody", N["isc-grant"]],
    "Unlicense": [N["unlicense"]],
}


def wrapped(paragraphs, prefix):
    lines = []
    for paragraph in paragraphs:
        for part in paragraph.split("\n"):
            lines += textwrap.wrap(part, 60) or [""]
        lines.append("")
    return "\n".join(prefix + line for line in lines)


def recognised(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licenses.recognise(rows).orderBy("doc_id").collect()


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_full_notices(spark, prefix):
    got = recognised(spark, [wrapped(paragraphs, prefix) for paragraphs in FULL.values()])
    assert [(r.licenses, r.left_over) for r in got] == [(name, "") for name in FULL]
    # GPL 3 is published with a colon and a comma, BSD also without an empty line.
    gpl = [x.replace("software;", "software:").replace("Foundation;", "Foundation,") for x in FULL["GPL-3.0-or-later"]]
    got = recognised(spark, [wrapped(gpl, prefix), wrapped([N["bsd-use"] + "\n" + BSD], prefix)])
    assert [(r.licenses, r.left_over) for r in got] == [("GPL-3.0-or-later", ""), ("BSD-3-or-2-Clause", "")]


def test_every_identifier_and_rule_is_reached(spark):
    texts = [*N.values(), *(" ".join(n.replace(";", ",").replace("v. ", "v ").split()) for n in N.values())]
    found = {id for r in recognised(spark, texts) for id in r.sentence_ids.split(",")}
    assert found == set(licenses.SENTENCES)
    assert [r.sentence_ids for r in recognised(spark, ["x. All rights\nreserved."])] == ["reserved"]
    rules = licenses.RULES
    got = recognised(spark, [".\n\n".join(licenses.SENTENCES[x] for x in wanted) for _, wanted in rules])
    assert [(r.sentence_ids, r.licenses, r.left_over) for r in got] == [(",".join(wanted), licence, "") for licence, wanted in rules]
    runs = ["".join(f",{x}," for x in wanted) for _, wanted in rules]
    assert not [run for i, run in enumerate(runs) if any(earlier in run for earlier in runs[:i])]
