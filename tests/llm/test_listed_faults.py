"""Cases that earlier versions of the operators got wrong or left open."""

import base64
import hashlib
import math
import random
import uuid

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from gridwise.llm import bpe, decontaminate, html_text, language, queries, secret_scan, topk

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PROSE = "The harbour was quiet in the morning, and the boats lay where the tide had left them, with nobody near. "


# --- pages ---

@pytest.mark.parametrize("page", [
    '<body><div class="post-content share"><p>{}</p></div></body>', '<body><div class="login-guide"><p>{}</p></div></body>',
    "<body><form><div><p>{}</p><input value=x><button>Send</button></div></form></body>",
    "<body><form><article><p>{}</p></article></form></body>", '<body><div id="related"><div><p>{}</p></div></div></body>',
    '<body><section class="share-prices"><p>{}</p></section><div class="share-bar">Send this page</div></body>',
    '<body><div class="widget"><p>{}</p></div><ul class="menu"><li><a href=x>One</a><li><a href=y>Two</a></ul></body>',
])
def test_names_do_not_drop_the_text(page):
    assert html_text.main_text(page.format(PROSE * 8)) == (PROSE * 8).strip()


@pytest.mark.parametrize("part", [
    '<div class="share">Send this to a friend of yours and to all others</div>', '<div class="share-buttons"><a href=x>Tell</a></div>',
    '<div class="user-comments"><p>{0}</p></div>', '<div id="cookie-notice"><p>We store data. Agree?</p></div>',
    '<form><p>Your name</p><input></form>', '<div class="login"><p>Enter here</p></div>', '<div class="related-posts"><p>See also</p></div>',
])
@pytest.mark.parametrize("holder", ["<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_furniture_still_goes(part, holder):
    page = "<body>" + holder.format(PROSE * 8) + part.format(PROSE * 2) + "</body>"
    assert html_text.main_text(page) == (PROSE * 8).strip()


def plain_densities(page, off, body):
    """Composite density by walking each element's subtree anew."""
    children = {i: [j for j in range(1, len(page.tag)) if page.parent[j] == i] for i in range(len(page.tag))}

    def walk(i, in_link):
        if off[i]:
            return np.zeros(4)
        in_link = in_link or page.tag[i] == "a" and i > 0
        own = sum(len("".join(t.split())) for j, t in page.texts if j == i)
        out = np.array([own, 1, own * in_link, 1 * in_link])
        for j in children[i]:
            out = out + walk(j, in_link)
        return out

    def density(i):
        c, t, lc, lt = walk(i, False)
        if off[i] or not c:
            return 0.0
        whole = walk(body, False)
        share = whole[2] / whole[0] if whole[0] else 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * max(math.log(c / max(lc, 1) * (t / max(lt, 1))), 0.0) / max(math.log(base), 1.0)

    found = [density(i) for i in range(len(page.tag))]
    sums = []
    for i in range(len(page.tag)):
        own = sum(len("".join(t.split())) for j, t in page.texts if j == i)
        sums.append(0.0 if off[i] or not walk(i, False)[0] else own + sum(found[j] for j in children[i]))
    return found, sums


def test_densities_equal_plain_ones():
    rng = random.Random(8)

    def element(depth):
        tag = rng.choice(["div", "p", "a", "span", "section", "ul", "b"])
        inner = "".join(element(depth - 1) if depth and rng.random() < 0.6 else " w" * rng.randrange(12) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        page = html_text.Page("<html><body>" + "".join(element(4) for _ in range(3)) + "</body></html>")
        off = [rng.random() < 0.05 and i > 2 for i in range(len(page.tag))]
        for i in range(1, len(off)):
            off[i] = off[i] or off[page.parent[i]]
        body = page.tag.index("body")
        got, want = html_text.densities(page, off, body), plain_densities(page, off, body)
        np.testing.assert_allclose(got[0], want[0], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-9)


# --- search ---

def test_rows_with_one_id_are_ranked_each(spark):
    rows = [(50, [1.0, 0.5], "x"), (50, [0.25, 1.0], "x"), (1, [1.0, 1.0], "x"), (2, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=3)
    vectors = [[math.floor(256 * x) for x in r[1]] for r in rows]
    want = []
    for q in (0, 1):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c])), rows[c][0]) for c in range(5) if c != q)
        want += [(50, i + 1, id, -s) for i, (s, id) in enumerate(scored[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- benchmark ---

def test_short_items_can_be_left_out(spark):
    docs = spark.createDataFrame([(1, "one plain word here"), (2, "six words stand in this text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word"), (2, "six words stand in this text"), (3, "  !"), (4, None)], "item_id long, text string")
    found = lambda least: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, least_words=least).collect()}
    assert found(1) == {(1, 1), (2, 2)} and found(5) == {(2, 2)} and found(7) == set()
    left = lambda least: {(r.item_id, r.n_words) for r in decontaminate.left_out(items, least).collect()}
    assert left(1) == {(3, 0), (4, 0)} and left(5) == {(1, 1), (3, 0), (4, 0)}
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, items, least_words=5).collect()] == [1]
    none = items.limit(0)
    assert decontaminate.remove_contaminated(docs, none).count() == 2 and decontaminate.contaminated(docs.limit(0), items).count() == 0


# --- language ---

@pytest.mark.parametrize("text, letter", [("½ ² Ⅷ", False), ("12 !", False), ("ﬁ", True), ("日", True), ("٣", False), ("ª", True), ("_", False)])
def test_letters(text, letter):
    assert language.has_letter(text) == letter


def test_clashing_column_is_replaced(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (2, "der Hund und die Katze", "de", "y")], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()}
    assert got == {1: "en", 2: "de"}


# --- token bytes ---

@pytest.mark.parametrize("ids", [[1, -1], [60_000], [None, 3]])
def test_unknown_ids_end_the_job(spark, ids):
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(df, MULTI).collect()


# --- repeated strings ---

def test_what_is_left_is_counted(spark, tmp_path):
    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    spark.createDataFrame([(1, "a" + shared), (2, shared + "bcd"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_kept) for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows == {1: (451, 450, 1), 2: (453, 450, 3), 3: (0, 0, 0)}


# --- secrets ---

def key(rng, kind, n):
    if kind == "base64":
        return base64.b64encode(rng.randbytes(n))[:n].decode().replace("=", "A")
    letters = {"hex": "0123456789abcdef", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}[kind]
    return "".join(rng.choice(letters) for _ in range(n))


def usable(x):
    return any(c.isdigit() for c in x) and any(c.isalpha() for c in x)


def spans_of(spark, texts):
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [[(s.start, s.end, s.kind) for s in r.spans] for r in rows]


def test_rests_beside_base_spans_are_tested(spark):
    rng = random.Random(1)
    access = "AKIA" + key(rng, "upper36", 16)
    rest = key(rng, "base62", 40)
    texts = [f"{access}/{rest}", f"x {rest}-{'a1' * 16} y", f"{rest}/{access}_{rest}", f"{access}/short9"]
    found = spans_of(spark, texts)
    n = len(access)
    assert found[0] == [(0, n, "access"), (n + 1, n + 41, "random")]
    assert (2, 42, "random") in found[1] and (43, 75, "hex") in found[1]
    assert found[2] == [(0, 40, "random"), (41, 41 + n, "access"), (42 + n, 82 + n, "random")]
    assert found[3] == [(0, n, "access")]


def test_precision_and_recall_on_planted_keys(spark):
    """Random keys among names, paths, numbers and encoded prose; shares by length are those that the README gives."""
    rng, texts, planted = random.Random(5), [], []
    for i in range(600):
        kind, n = rng.choice(["base62", "base64", "upper36"]), rng.choice([24, 32, 40, 64])
        secret = key(rng, kind, n)
        decoy = rng.choice([
            "/usr/local/share/applications/org/version2/settings", "thisIsAVeryLongMethodNameOfVersion2Handler", "2024" * 8 + "a",
            "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "some_long_column_name_with_number_12_in_it",
            base64.b64encode(PROSE.encode()).decode()[:64],
        ])
        texts.append(f"{PROSE} {secret} and {decoy} end")
        planted.append((len(PROSE) + 1, len(PROSE) + 1 + n, n) if usable(secret) else None)
    found = spans_of(spark, texts)
    reported = sum(len(f) for f in found)
    hits = {n: [0, 0] for n in (24, 32, 40, 64)}
    for f, p in zip(found, planted):
        if p:
            hits[p[2]][0] += (p[0], p[1], "random") in f
            hits[p[2]][1] += 1
    right = sum(h[0] for h in hits.values())
    shares = {n: h / all for n, (h, all) in hits.items()}
    print("recall by length", shares, "precision", right / reported)
    assert all(share >= 0.85 for share in shares.values()), shares
    assert right / reported >= 0.75, right / reported


def test_digest_of_joined_spans(spark, tmp_path):
    secret = uuid.UUID(int=0x123456789ABCDEF0123456789ABCDEF0).hex
    spark.createDataFrame([(1, f"id {secret} end"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_hex, r.base_sha256) for r in queries.op9_secrets(spark, str(tmp_path)).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows == {1: (1, digest("hex:3:35")), 2: (0, digest(""))}
