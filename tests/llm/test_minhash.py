import random
import re

import numpy as np
import pytest
from plain import AWKWARD, documents

from gridwise.llm import minhash, queries


def shingles(text, size=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def plain(rows, size=4):
    """(id, shingles, component, kept) by comparing all pairs."""
    sets = [shingles(text, size) for _, text in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least[find(i)] = min(least.get(find(i), id), id)
    return sorted(
        ((id, len(sets[i]), least.get(find(i)), id == least.get(find(i))) for i, (id, _) in enumerate(rows)), key=str
    )


def crowd(rng, count, words=40, edits=3, base=None):
    """Texts that differ from one another in a few words."""
    base = base or [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def found(spark, rows, size=4):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(df, size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("region", [512, 8])
def test_equals_plain(spark, monkeypatch, region):
    """With small regions crowds go deeper, and are dealt into cells."""
    monkeypatch.setattr(minhash, "REGION", region)
    rng = random.Random(11)
    texts = [r[1] for r in AWKWARD]
    for count, words, edits in ((120, 60, 4), (60, 30, 2), (40, 200, 12), (30, 12, 1)):
        texts += crowd(rng, count, words, edits)
    # Chains: neighbours are linked, the ends are not.
    chain = [f"c{i}" for i in range(90)]
    texts += [" ".join(chain[i : i + 50]) for i in range(0, 40, 2)]
    # Texts of one passage and an own part, too far from one another.
    texts += [" ".join(chain) + " " + " ".join(f"o{i} {k}" for i in range(12)) for k in range(40)]
    texts += ["one", "ONE", "one two three", "One two  three\n", " ", "b c d e", "b c d e b c d e b c d e"]
    rows = [(i if i % 41 else None, t) for i, t in enumerate(texts)]
    rows += rows[:20] + [(5, "repeated id")]
    rng.shuffle(rows)
    want = plain(rows)
    assert len({r[2] for r in want}) < len(rows) - 100
    assert found(spark, rows) == want


def test_equal_signatures(spark, monkeypatch):
    """More different sets than a region holds, all with nearly the same signature."""
    monkeypatch.setattr(minhash, "REGION", 4)
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(base[: 3000 - i])) for i in range(30)]
    assert found(spark, rows) == plain(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (None, " ")]) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        equal = []
        for _ in range(60):
            n = 400
            common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2))
            one, two = (np.frombuffer(minhash.signature(x), "<u2") for x in (a, b))
            equal.append(np.mean(one == two))
        assert abs(np.mean(equal) - share) < 0.02


def test_query(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_minhash(spark, str(tmp_path)).collect()), key=str)
    assert got == plain([r[:2] for r in AWKWARD])
