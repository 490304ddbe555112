import random

import numpy as np
import pandas as pd
import plain
import pytest
from plain import AWKWARD, documents
from pyspark.sql import functions as F

from gridwise.llm import components, decontaminate, simhash, suffix_dedup, topk


def brute_top(rows, k):
    usable = [
        (i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def top(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **options).collect()))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # ties
    rows += [(None, [0.0] * 8), (50_000, None), (50_050, [1.0, None]), (50_100, [float("nan")] * 8), (50_150, [float("inf")] * 8)]
    rows += [(60_000, [1.0, 2.0]), (60_001, [1.0, 2.0]), (60_050, []), (70_000, [1e9] * 8)]
    assert top(spark, rows) == brute_top(rows, 5)
    assert top(spark, rows[:3], k=5) == brute_top(rows[:3], 5)
    assert top(spark, []) == []


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) + (i % 3) * 4).tolist()) for i in range(500)]
    assert top(spark, rows, k=7, pivots=8) == brute_top(rows, 7)


def test_bounds_spare_products():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 8)) * 2000
    points = np.floor(np.repeat(centre, 100, axis=0) + rng.normal(size=(2000, 8)) * 20)
    pivots = points[::100]
    frame = lambda x, first: pd.DataFrame({
        "id": range(first, first + len(x)), "row": range(first, first + len(x)), "v": [r.tobytes() for r in x],
        "d": [np.sqrt(((pivots - r) ** 2).sum(axis=1)).tobytes() for r in x],
    })
    *_, evaluated = topk.best_in_block(frame(points[:10], 5000), frame(points, 0), 5)
    assert evaluated < 10 * 2000 / 2


@pytest.mark.parametrize("length", [120, 400])
def test_repeated_strings(spark, length):
    rng = random.Random(length)
    words = [f"{rng.getrandbits(30):x}" for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts = [r[1] for r in AWKWARD]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(150))) + passage[rng.randrange(300) :] + rng.choice(words) * 3 for _ in range(25)]
    texts += ["ab" * 700, "ab" * 500 + "!", passage[:length], passage[: length - 1], "x" * length, "x" * (length + 3)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, k1 int")
    got = suffix_dedup.removed(df, [
        F.col("n_bytes"), F.octet_length("kept").alias("left_bytes"), F.size("spans").alias("spans"), F.sha2("kept", 256).alias("digest"),
    ], length).select("doc_id", "n_bytes", (F.col("n_bytes") - F.col("left_bytes")).alias("cut"), "spans", "digest").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain.cut(texts, length)


def test_crowded_anchors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(300))) + passage[rng.randrange(400) :] for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.removed(df, [F.col("n_bytes"), F.octet_length("kept").alias("left"), F.size("spans").alias("spans"), F.sha2("kept", 256).alias("d")])
    rows = [(r.n_bytes, r.n_bytes - r.left, r.spans, r.d) for r in got.orderBy("doc_id").collect()]
    assert rows == plain.cut(texts, 400)


def test_nothing_to_cut(spark):
    assert suffix_dedup.removed(documents(spark).limit(0), [F.col("n_bytes")]).count() == 0


def test_difference_cover():
    for period in (1, 7, 64, 91):
        covered, offsets = suffix_dedup.common_offsets(period)
        assert len(suffix_dedup.difference_cover(period)) <= 2.2 * period**0.5 + 1
        for a in range(period):
            for b in range(period):
                assert covered[(a + offsets[a, b]) % period] and covered[(b + offsets[a, b]) % period]


def test_sort_block_with_many_ties():
    rng = random.Random(6)
    head, tail = "h" * 70, "t" * 70
    runs = [(head + "".join(rng.choice("xy") for _ in range(60)) + tail).encode() for _ in range(80)]
    runs += [runs[3], runs[9]]
    got = suffix_dedup.sort_block(runs, 200)
    assert [bool(x[0]) for x in got] == [runs.count(r) > 1 for r in runs]


def near_rows(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, id_ = list(AWKWARD), 100
    for group in range(6):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(12):
            words = list(words)
            words[rng.randrange(400)] = rng.choice(vocabulary)
            rows.append((id_, " ".join(words), "en", "s", 0))
            id_ += 1
    return rows


def test_fingerprints_and_components(spark):
    rows = near_rows()
    df = documents(spark, rows).withColumn("fp", F.lit("clash")).withColumn("k1", F.lit(0))
    found = simhash.near_duplicates(df).select("doc_id", (F.col("fp")).alias("fp"), "component_id").collect()
    prints = [plain.fingerprint(r[1]) for r in rows]
    labels = plain.linked(prints)
    least = {}
    for r, label in zip(rows, labels):
        if r[0] is not None:
            least[label] = min(least.get(label, r[0]), r[0])
    want = sorted(((r[0] or -1), p, least.get(label) or -1) for r, p, label in zip(rows, prints, labels))
    assert sorted(((r.doc_id or -1), r.fp % 2**64, r.component_id or -1) for r in found) == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(labels))
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == sorted(least.values())
    assert set(simhash.keep_one(df).columns) == set(df.columns)


def test_links_of_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rng = random.Random(8)
    values = set()
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(30):
            value = centre
            for bit in rng.sample(range(64), rng.randrange(6)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node % 2**64: r.root for r in components.components(simhash.links(df, 4)).collect()}
    labels = plain.linked(values)
    groups = {}
    for v, label in zip(values, labels):
        groups.setdefault(label, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(9)
    groups = [list(range(0, 16)), list(range(16, 32)), list(range(32, 48)), list(range(48, 64))]
    counts = [rng.integers(0, 1000, 1 << 16) for _ in groups]
    plan = simhash.Plan(4, groups, [simhash.estimates(c, 16, 4) for c in counts])
    prints = rng.integers(-(1 << 62), 1 << 62, 200)
    given = simhash.thresholds(plan, prints)
    assert ((given + 1).sum(axis=0) == 5).all() and given.min() >= -1
    # The program's choice costs no more than equal shares.
    cost = lambda t: sum(
        plan.expected[g][t[g]][simhash.value_of(prints[:1], groups[g])[0]] + simhash.PROBE_COST * simhash.ball(16, t[g]) for g in range(4) if t[g] >= 0
    )
    assert cost(given[:, 0]) <= min(cost([1, 0, 0, 0]), cost([0, 1, 0, 0]), cost([0, 0, 0, 1])) + 1e-6


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {x: x for pair in links for x in pair}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if any(x in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


ITEMS = [
    (1, " ".join(f"q{i}" for i in range(60))), (2, "Three word item"), (3, None), (4, ""), (5, "!!!"),
    (6, " ".join(["again and again"] * 8)), (7, " ".join(f"q{i}" for i in range(60))), (8, " ".join(f"r{i}" for i in range(12))),
]


def leaks():
    item, rows = ITEMS[0][1].split(), list(AWKWARD)
    changed = [*item[:30], "other", *item[31:]]
    rows.append((20, "before " + ITEMS[0][1].upper() + ", after.", "en", "s", 0))
    rows.append((21, " ".join(changed) + " tail of the text", "en", "s", 0))
    rows.append((22, " ".join([*item[:20], "x", *item[21:40], "y", *item[41:]]), "en", "s", 0))
    rows.append((23, "some three word item; " * 3 + ITEMS[7][1].replace(" ", "\n"), "en", "s", 0))
    rows.append((24, " ".join(["again and again"] * 20), "en", "s", 0))
    rows.append((25, " ".join(item[:40]), "en", "s", 0))
    rows.append((26, "lead " + " ".join([*item[1:], "more"]) + " " + " ".join(item), "en", "s", 0))
    return rows


@pytest.mark.parametrize("inline", [True, False])
def test_contaminated(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(decontaminate, "INLINE_ANCHORS", 3)
    rows = leaks()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = documents(spark, rows).withColumn("similarity", F.lit("clash")).withColumn("n", F.lit(1))
    found = decontaminate.contaminated(df, items).collect()
    want = plain.contaminated([(r[0], r[1]) for r in rows], ITEMS)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found} == want
    assert {d for d, _ in want} == {20, 21, 23, 24, 26}
    kept = decontaminate.remove_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5


def test_decontaminate_against_nothing(spark):
    df, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.remove_contaminated(df, items.limit(0)).count() == len(AWKWARD)
    assert decontaminate.contaminated(df.limit(0), items).count() == 0


def test_index_finds_all_within_the_distance():
    """Radii and blocks: two fingerprints that miss each other in every block differ in more bits than the distance."""
    assert sum(r + 1 for _, r in decontaminate.BLOCKS) >= decontaminate.DISTANCE + 1 and sum(w for w, _ in decontaminate.BLOCKS) == 64


def test_a_block_is_scored_in_two_rounds(monkeypatch):
    """However many candidates the bounds leave, a query multiplies the block at most twice, not once for each few of them."""
    rounds = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            rounds.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(8)
    v = rng.integers(-256, 257, (3000, 24)).astype("<f8")
    table = pd.DataFrame({"id": range(3000), "row": range(3000), "v": [x.tobytes() for x in v], "d": [b""] * 3000})
    plain = topk.stack
    monkeypatch.setattr(topk, "stack", lambda column: plain(column).view(Counted))
    asked, ids, scores, _ = topk.best_in_block(table[:5], table, 5)
    assert len(rounds) <= 3 * 5  # with the length of the query
    for i in range(5):
        want = sorted(((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i))[:5]
        assert [(-s, j) for a, j, s in zip(asked, ids, scores) if a == i] == want
