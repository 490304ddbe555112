"""Byte-level BPE encoding and decoding through the distinct words of the corpus.

Texts are taken in blocks of bounded bytes. Each block gives its distinct pre-tokens ("words"), dealt to buckets by a hash
of the word, and for each text the positions: a sequence of word ranks in the block. A bucket holds all occurrences of its
words in any block and encodes each word once; the ids go back to the blocks, where each text's sequence is replaced by
the ids of its words, in order. Decoding looks ids up in the table of token bytes, whose size the vocabulary bounds.

Words and ranks travel packed and compressed, one row for each block and bucket. A block's dictionary has at most as many
words as the block, so no group grows with the corpus, however frequent a word or a text is.

The input is read twice and must give the same partitions both times, as a scan of stored files does; otherwise the job
fails rather than giving other ids. Null and empty texts have no ids. Special strings in texts are ordinary text.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridwise.llm.common import fresh, hand_back, once, tidied

BLOCK_BYTES = 4 << 20
MOST_BUCKETS = 4096
#: Rows that are decoded at once.
DECODED_ROWS = 256
#: An encoder forgets its words beyond this number, which costs time only.
MOST_WORDS = 200_000
# Characters whose classes have been settled since long: Latin letters, dashes and quotation marks.
SETTLED = [*range(0x250), *range(0x2010, 0x2028)]
SPACES = "\t-\r \x85\xa0"
WORD_ROWS = "b1 long, b2 long, bucket int, words binary, ranks binary"
ID_ROWS = "b1 long, b2 long, bucket int, ids binary, lengths binary, ranks binary"


def ranges(numbers: list[int]) -> str:
    """A character class of these code points."""
    out, start = [], 0
    for i, n in enumerate(numbers):
        if i + 1 == len(numbers) or numbers[i + 1] != n + 1:
            first, last = re.escape(chr(numbers[start])), re.escape(chr(n))
            out.append(first if start == i else f"{first}-{last}")
            start = i + 1
    return "".join(out)


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text. Texts of settled characters only take a pattern with the classes written out."""
    letters, numbers = (ranges([n for n in SETTLED if unicodedata.category(chr(n))[0] == kind]) for kind in "LN")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
    plain = plain.replace(r"\p{N}", f"[{numbers}]").replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"\s", f"[{SPACES}]")
    fast, full, other = re.compile(plain), regex.compile(pattern), re.compile(f"[^{ranges(SETTLED)}]")
    return lambda text: full.findall(text) if other.search(text) else fast.findall(text)


def ranks_at(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token by its id; the ids of a vocabulary have no gaps."""
    ranks = ranks_at(path)
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"the ids in {path} have gaps")
    table = np.empty(len(ranks), object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encoder(path: str, pattern: str) -> Callable[[bytes], list[int]]:
    """Ids of one word."""
    import tiktoken

    def make() -> tiktoken.Encoding:
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_at(path), special_tokens={})

    return once("bpe encoding", (path, pattern), make)._encode_single_piece


def pack(array: np.ndarray) -> bytes:
    """Unsigned numbers, by planes of equal bytes, compressed."""
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(4, "little") + lengths + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends.tolist()]
    return [raw[a:b] for a, b in zip(starts, starts[1:])]


class Block:
    """Distinct words of some texts by falling frequency, and each text as a sequence of their ranks."""

    def __init__(self, texts: list[str | None], split: Callable[[str], list[str]]) -> None:
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        sequences = []
        for text in texts:
            words = split(text) if text else []
            sequences.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        number.default_factory = None  # it holds the table, which would wait for the collector of cycles
        distinct = list(number)
        counts = np.bincount(np.concatenate([np.empty(0, np.uint32), *sequences]), minlength=len(distinct))
        order = np.argsort(-counts, kind="stable")
        self.words = [distinct[i].encode() for i in order]
        rank = np.empty(len(distinct), np.uint32)
        rank[order] = np.arange(len(distinct))
        self.sequences = [rank[s] for s in sequences]


def in_blocks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about `most` bytes of `column`. Blocks depend on the rows alone, not on the batches they come
    in, which other columns change."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if size and size + n > most:
                yield from joined([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    yield from joined(held)


def joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    parts = [p for p in parts if p.num_rows]
    return [pa.concat_batches(parts)] if parts else []


def blocks_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], pa.RecordBatch]]:
    """Blocks with their keys: two numbers of the task, the place in it and the texts."""
    place = TaskContext.get().partitionId()
    for i, batch in enumerate(in_blocks(batches, column, BLOCK_BYTES)):
        digest = xxhash.xxh3_64()
        for text in batch.column(column).to_pylist():
            digest.update(b"\xff" if text is None else text.encode() + b"\xfe")
        yield [place << 32 | i, int.from_bytes(digest.digest(), "little", signed=True)], batch


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` without the text, with its token ids; a column named `ids` is replaced."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    b1, b2, sequence = (fresh(rest, x) for x in ("b1", "b2", "sequence"))
    buckets = min(MOST_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for key, batch in blocks_of(batches, 0):
            dealt: list[list[int]] = [[] for _ in range(buckets)]
            block = Block(batch.column(0).to_pylist(), split).words
            for rank, word in enumerate(block):
                dealt[xxhash.xxh3_64_intdigest(word) % buckets].append(rank)
            used = [b for b in range(buckets) if dealt[b]]
            yield pa.RecordBatch.from_pydict({
                "b1": pa.array([key[0]] * len(used), pa.int64()), "b2": pa.array([key[1]] * len(used), pa.int64()),
                "bucket": pa.array(used, pa.int32()),
                "words": pa.array([pack_words([block[r] for r in dealt[b]]) for b in used], pa.binary()),
                "ranks": pa.array([pack(np.diff(dealt[b], prepend=0)) for b in used], pa.binary()),
            })

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = encoder(path, pattern)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            all_ids, all_lengths = [], []
            for packed in batch.column(3).to_pylist():
                if len(known) > MOST_WORDS:
                    known.clear()
                found = []
                for word in unpack_words(packed):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encode_word(word), "<u4").tobytes()
                    found.append(got)
                all_ids.append(pack(np.frombuffer(b"".join(found), "<u4")))
                all_lengths.append(pack(np.array([len(x) // 4 for x in found])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(all_ids, pa.binary()), pa.array(all_lengths, pa.binary()), batch.column(4)],
                names=["b1", "b2", "bucket", "ids", "lengths", "ranks"],
            )

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for key, batch in blocks_of(batches, 0):
            block = Block(batch.column(0).to_pylist(), split)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()),
                 pa.array([pack(s) for s in block.sequences], pa.binary()), *batch.columns[1:]],
                names=[b1, b2, sequence, *rest],
            )

    def reassembled(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise ValueError("the input gave other blocks when it was read again")
        parts = [[unpack(x) for x in dictionary.column(c).to_pylist()] for c in ("ids", "lengths", "ranks")]
        flat, lengths = (np.concatenate([np.empty(0, np.uint32), *p]).astype(np.int64) for p in parts[:2])
        ranks = np.concatenate([np.empty(0, np.int64), *[np.cumsum(p, dtype=np.int64) for p in parts[2]]])
        starts, sizes = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        starts[ranks] = np.cumsum(lengths) - lengths
        sizes[ranks] = lengths
        out, ends = [np.empty(0, np.int64)], [0]
        for packed in texts.column(2).to_pylist():
            order = unpack(packed).astype(np.int64)
            if len(order) and order.max() >= len(sizes):
                raise ValueError("the input gave other blocks when it was read again")
            many = sizes[order]
            shift = starts[order] - (np.cumsum(many) - many)
            out.append(flat[np.repeat(shift, many) + np.arange(many.sum())])
            ends.append(ends[-1] + len(out[-1]))
        hand_back()
        values = pa.array(np.concatenate(out).astype(np.int32))
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)
        return pa.table([*texts.columns[3:], lists], names=[*rest, ids])

    columns = [f"`{c}`" for c in rest]
    chosen = docs.select(F.col(f"`{text}`").cast("string").alias(fresh(rest, "text")), *columns)
    dictionary = chosen.select(f"`{chosen.columns[0]}`").mapInArrow(tidied(words), WORD_ROWS).repartition("bucket").mapInArrow(tidied(encoded), ID_ROWS)
    long, binary = F.lit(0).cast("long"), F.lit(b"")
    shape = docs.select(long.alias(b1), long.alias(b2), binary.alias(sequence), *columns).schema
    left = chosen.mapInArrow(tidied(sequences), shape)
    result = docs.select(*columns, F.array(F.lit(0)).alias(ids)).schema
    return left.groupBy(b1, b2).cogroup(dictionary.groupBy("b1", "b2")).applyInArrow(reassembled, result)


def decode(
    encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = "",
) -> DataFrame:
    """`encoded` with the bytes of its ids, null for null ids; a column named `decoded` is replaced.

    An id that the vocabulary doesn't have, or a null among the ids, ends the job. `finish` makes other columns, of the given
    schema, of each batch in the same pass, where the bytes themselves aren't wanted.
    """
    rest = [c for c in encoded.columns if c != decoded]
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once("bpe tokens", path, lambda: token_bytes(path))
        for whole in batches:
            for start in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(start, DECODED_ROWS)
                found = pa.RecordBatch.from_arrays([*batch.columns, texts_of(tokens, batch.column(at))], names=[*rest, decoded])
                yield finish(found) if finish else found

    columns = [f"`{c}`" for c in rest]
    shape = schema if finish else encoded.select(*columns, F.lit(b"").alias(decoded)).schema
    return encoded.select(*columns).mapInArrow(tidied(run), shape)


def texts_of(tokens: np.ndarray, lists: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for."""
    flat = lists.flatten()
    unknown = flat.filter(pc.fill_null(pc.or_(pc.less(flat, 0), pc.greater_equal(flat, len(tokens))), True))
    if len(unknown):
        raise ValueError(f"no token has the id {unknown[0]}")
    each = tokens[flat.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    return pa.array([b"".join(each[a:b].tolist()) if v else None for a, b, v in zip([0, *ends], ends, lists.is_valid().to_pylist())], pa.binary())
