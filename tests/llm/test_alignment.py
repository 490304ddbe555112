import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from plain import AWKWARD, LONG, documents
from tokenizers import Tokenizer

from gridwise.llm import alignment, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b   c", " leading", "trailing ", "   ", " ", "\n\n x \t y", "a<|endoftext|>b", "<s> </s> <unk> <0x41>", "▁ under ▁▁x", "ﬁ ½ Ⅷ é",
    "日本語 テキスト", "\U0001f469‍\U0001f52c ok", "x" * 3000, "don't I'll 'RE", "٣ ३ ²", "a b　c", "\x00\x01 nul",
]


def plain_groups(texts):
    """Per text (ids of A, ids of B, groups, links) by comparing end offsets."""
    one = Tokenizer.from_file(JSON)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    symbols = alignment.byte_of_symbol()

    def bytes_a(id):
        return bytes(symbols[c] for c in one.id_to_token(id))

    def bytes_b(id):
        found = re.fullmatch("<0x(..)>", two.id_to_piece(id))
        return bytes.fromhex(found[1]) if found else two.id_to_piece(id).replace("▁", " ").encode()

    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        pieces = [[bytes_a(i) for i in a], [bytes_b(i) for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
        both = set(ends[0]) & set(ends[1])
        groups, links, i, j = [], [], 0, 0
        for end in sorted(both):
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        out.append((a, b, groups, links))
    return out


def plain_rows(texts):
    found = plain_groups(texts)
    counts = Counter(link for x in found for link in x[3])
    best = {}
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text,
        ))
    return rows


def test_alignment_equals_plain(spark):
    rng = random.Random(3)
    texts = [r[1] for r in AWKWARD] + ODD + ["".join(rng.choice(" aeéß▁ \nthe日") for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, n_links string, extra string")
    got = alignment.alignment(df, JSON, MODEL)
    assert got.columns == ["doc_id", "extra", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    got = got.orderBy("doc_id").collect()
    want = plain_rows(texts)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got] == want
    assert any(r[0] for r in want) and sum(r[0] == 0 for r in want) > 3


def test_pieces_of_units_equal_the_library():
    side = alignment.PieceSide(MODEL)
    assert side.by_unit
    rng = random.Random(5)
    texts = ODD + [LONG] + ["".join(rng.choice(" ab▁é\n.") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    assert [side.ids(t) for t in texts] == [side.library.encode(t) for t in texts]


def test_pointers_end_at_the_last_token():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 60)
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n))}) for _ in range(2)]
        last = alignment.terminals(*[np.array(x) for x in ends])
        both = sorted(set(ends[0]) & set(ends[1]))
        want = [ends[1].index(min(c for c in both if c >= e)) for side in ends for e in side]
        assert last.tolist() == want


def test_query_and_empty_table(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.n_a, r.n_b, r.groups_sha256, r.count_sum) for r in queries.op13_alignment(spark, str(tmp_path)).collect()}
    want = plain_rows([r[1] for r in AWKWARD])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    assert rows == {(r[0], w[0], w[1], digest(w[6]), w[5]) for r, w in zip(AWKWARD, want)}
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_alignment(spark, f"{tmp_path}/none").count() == 0
