"""Pages on which the threshold on the path decides what belongs to the text."""

import pytest

from gridwise.llm import html_text

ONE = "The first part of the text is long enough to be the densest node of the page, with many words in it, by far."
TWO = "The second part stands beside it and is as dense as the first one, so that it belongs to the text as well, no doubt."
LINKS = "<ul>" + "<li><a href=x>Go</a>" * 30 + "</ul>"


def paragraphs(text, n):
    return f"<p>{text}</p>" * n


@pytest.mark.parametrize("before, after", [
    ("<article>{}</article>", "<article>{}</article>"), ("<article>{}</article>", "<section>{}</section>"),
    ("<section>{}</section>", "<article>{}</article>"), ("<main>{}</main>", "<section>{}</section>"),
    ("<section>{}</section>", "<section>{}</section>"), ("<div><article>{}</article></div>", "<div><article>{}</article></div>"),
])
def test_dense_siblings_belong_to_the_text(before, after):
    first, second = before.format(paragraphs(ONE, 6)), after.format(paragraphs(TWO, 4))
    html = f"<html><body><div>{LINKS}</div><div>{first}{second}</div><div>{LINKS}</div></body></html>"
    assert html_text.main_text(html) == " ".join([ONE] * 6 + [TWO] * 4)


def test_an_article_is_taken_whole_and_thin_siblings_are_not():
    html = f"<body><div>{LINKS}</div><article><h1>Head</h1><div>{paragraphs(ONE, 6)}</div><p>End</p></article><div>{LINKS}</div></body>"
    assert html_text.main_text(html) == " ".join(["Head", *[ONE] * 6, "End"])


def test_three_articles():
    parts = [paragraphs(x, n) for x, n in ((ONE, 5), (TWO, 2), (ONE, 3))]
    html = f"<body><div>{LINKS}</div><div>" + "".join(f"<article>{x}</article>" for x in parts) + f"</div><div>{LINKS}</div></body>"
    assert html_text.main_text(html) == " ".join([ONE] * 5 + [TWO] * 2 + [ONE] * 3)
