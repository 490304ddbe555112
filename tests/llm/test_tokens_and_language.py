import hashlib
import random
import unicodedata
import uuid
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from plain import AWKWARD, LONG, SHARED, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwise.llm import bpe, language, queries, token_count

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "don't  stop\n\n now", "a<|endoftext|>b  <|endoftext|>\n", "日本語 text  next", "\x00\x1c \x85\xa0 　x", "'S 's 'RE're'",
    "²½12٣", "é̀ \U0001f469‍\U0001f52c", "   ", "\t\ta \n b\r\n", "tail space ", "x" * 3000, "ıİǅ ‘q’ “q”",
]


def settled_texts(count, seed):
    rng = random.Random(seed)
    letters = [chr(n) for n in bpe.SETTLED if unicodedata.category(chr(n)) != "Cn"] + list(" \n\t  'stre") * 20
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(count)]


def test_counts_equal_the_library(spark):
    texts = [r[1] for r in AWKWARD] + ODD + settled_texts(300, 1)
    library = Tokenizer.from_file(JSON)
    want = [len(library.encode(t, add_special_tokens=False)) if t else 0 for t in texts]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = token_count.count_tokens(df, JSON).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want
    assert token_count.count_tokens(df.limit(0), JSON).count() == 0


def test_every_settled_character_counts_as_in_the_library():
    counter = token_count.Counter(JSON)
    texts = [f"{a}{chr(n)}{b}" for n in bpe.SETTLED for a in ("", " ", "a", "1", "!") for b in ("", "b", " b")]
    assert counter.counts(texts) == [len(x) for x in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_cut_safely():
    counter = token_count.Counter(JSON)
    for text in (LONG, "  ".join(ODD) * 20, "no boundary" * 50):
        pieces = token_count.pieces_of(text, 50)
        assert "".join(pieces) == text
        assert sum(counter.counts(pieces)) == len(counter.library.encode(text, add_special_tokens=False))
    assert len(token_count.pieces_of(LONG, 50)) > 1000


@pytest.mark.parametrize("block", [1 << 23, 100])
def test_encode_and_decode(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    texts = [r[1] for r in AWKWARD] + ODD + settled_texts(60, 2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_at(MULTI), special_tokens={})
    rows = [(i, t, "clash", 1, [i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence string, b1 int, ids array<int>")
    found = bpe.decode(bpe.encode(df, MULTI, public_tokenizers.PATTERN), MULTI)
    assert found.columns == ["doc_id", "sequence", "b1", "ids", "decoded"]
    got = found.orderBy("doc_id").collect()
    assert [r.ids for r in got] == [own.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for t in texts]


def test_encode_nothing_and_lose_blocks(spark):
    df = documents(spark)
    assert bpe.encode(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
    changing = lambda frames: (f.assign(text=str(uuid.uuid4())) for f in frames)  # noqa: E731  other texts at each reading
    shuffled = df.mapInPandas(changing, df.schema)
    with pytest.raises(Exception, match="other blocks"):
        bpe.encode(shuffled, MULTI, public_tokenizers.PATTERN).collect()


def test_digests(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_at(MULTI), special_tokens={})
    want = sorted(
        (r[0] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for r in AWKWARD for ids in [own.encode_ordinary(r[1] or "")]
    )
    assert sorted((r[0] or 0, *r[1:]) for r in queries.token_digests(documents(spark)).collect()) == want


def phrases(text, sample):
    """Greedy parse of each block into the longest phrases found in the sample."""
    count = 0
    for start in range(0, len(text), language.BLOCK):
        block = text[start : start + language.BLOCK]
        while block:
            n = next((n for n in range(len(block), 0, -1) if block[:n] in sample), 0)
            count, block = count + 1, block[max(n, 1) :]
    return count


def test_phrases_by_brute_force():
    rng = random.Random(4)
    samples = language.Samples(("a", "b"), tuple("".join(rng.choice(x) for _ in range(300)).encode() for x in ("abcd ", "cdef ")))
    texts = ["".join(rng.choice("abcdefz ") for _ in range(rng.randrange(60))).encode() for _ in range(60)] + [b"", b"a" * 5000]
    got = language.Parser(samples).phrases(texts)
    assert got.tolist() == [[phrases(t, s) for s in samples.texts] for t in texts]


def labelled(seed, count, with_labels=True):
    rng = random.Random(seed)
    syllables = {"aa": "ba ke li mo nu".split(), "bb": "sch ung heit ver ge".split(), "cc": "cion que ado es la".split()}
    rows = []
    for i in range(count):
        name = rng.choice(sorted(syllables))
        words = ["".join(rng.choice(syllables[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 40))]
        rows.append((i, " ".join(words), name if with_labels else None, "s", 0))
    return rows


def test_language_of_held_out_texts(spark):
    rows = labelled(5, 400)
    df = documents(spark, rows).withColumn("score", F.lit("clash"))
    samples = language.learn(df.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    assert samples.names == ("aa", "bb", "cc") and max(map(len, samples.texts)) <= 2 * language.BYTES_PER_LANGUAGE
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df.drop("lang"), samples).collect()}
    held_out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[r[0]][0] == r[2] for r in held_out) >= 0.98 * len(held_out)
    assert all(0 <= s <= 1 for _, s in found.values())


def test_language_of_awkward_texts(spark):
    df = documents(spark, [(1000 + (r[0] or 0), *r[1:]) for r in AWKWARD] + labelled(6, 60))
    found = {r.doc_id: r for r in language.identify(df, language.learn(df)).collect()}
    for i in (1001, 1002, 1003, 1009):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[1008].lang_pred != "und"
    empty = language.learn(df.where("lang is null"))
    assert empty.names == () and {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(df.limit(0), empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"quiz{i} question" for i in range(30))
    rows = labelled(7, 120) + [(1000 + i, *r[1:]) for i, r in enumerate(AWKWARD)]
    rows += [(2000, rows[3][1], "aa", "s", 0), (2001, "intro " + item + " outro", "aa", "s", 0)]
    rows += [(2002, rows[4][1] + " password=abcdefgh12345 " + rows[5][1], "aa", "s", 0)]
    folder = str(tmp_path)
    documents(spark, rows).withColumn("fp", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    # The plain version: rejected texts, then one of each component, then leaks, then masked secrets, then ids.
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    labels = plain.linked([plain.fingerprint(r[1]) for r in left])
    first = {}
    for r, label in zip(left, labels):
        first[label] = min(first.get(label, r), r, key=lambda x: (x[0] is None, x[0]))
    leaks = plain.contaminated([(r[0], r[1]) for r in first.values()], [(1, item)])
    kept = [r for r in first.values() if (r[0], 1) not in leaks]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_at(MULTI), special_tokens={})
    want = {}
    for r in kept:
        text = r[1].replace("password=abcdefgh12345", "[SECRET]")
        want[r[0]] = (len(own.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and 2000 not in got and 2001 not in got and 2002 in got
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    rows_left = docs.collect()
    assert {r.doc_id for r in rows_left} == set(want) and len(rows_left) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows_left) and not any("abcdefgh12345" in r.text for r in rows_left)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    items = "item_id long, text string"
    for name, docs, benchmark in (("a", [], [(1, "one two three four five six")]), ("b", [], []), ("c", labelled(3, 6), [])):
        documents(spark, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(benchmark, items).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (got.count() > 0) == bool(docs)


@pytest.mark.parametrize("rows", [1, 2, 7, 100])
def test_blocks_do_not_depend_on_batches(rows):
    import pyarrow as pa

    texts = ["x" * (i * 37 % 90) if i % 9 else None for i in range(100)]
    whole = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    batches = [whole.slice(i, rows) for i in range(0, 100, rows)]
    got = [b.column(0).to_pylist() for b in bpe.in_blocks(iter(batches), 0, 200)]
    assert got == [b.column(0).to_pylist() for b in bpe.in_blocks(iter([whole]), 0, 200)] and sum(got, []) == texts
    assert all(sum(len(t or "") for t in g) <= 200 for g in got) and list(bpe.in_blocks(iter([]), 0, 5)) == []
