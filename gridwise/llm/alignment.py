"""Alignment of two tokenizers' tokens of the same text, by pointer jumping.

A text, with a space before it, is cut into the tokens of a byte-level vocabulary (A) and of a sentence-piece vocabulary
(B, which adds that space itself). Tokens of A and B that share bytes belong together. Every token points to its
farthest-right overlapping token of the other side, or to itself if none ends later (where both end together, to the one
of B). Doubling all pointers at once until none moves takes every token to the last token of its group, whose place labels
the group. A batch of texts is one array of tokens, so the doubling is a few array operations.

Where both sides end together, their tokens are linked. How often a pair of ids is linked is counted over all texts. The
shorter token of a link ends the longer one, so the vocabularies bound the number of pairs, not the corpus: a byte string
has few endings. The table of counts is therefore small enough for every worker.

Special strings in texts are ordinary text. Null and empty texts have no tokens, and so have texts whose tokens' bytes of
either side don't join to the text; their counts are 0 and their groups the empty string. Repeated rows count each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwise.llm.common import by_bytes, fresh, once, stored
from gridwise.llm.token_count import Counter, SETTLED, byte_of_symbol

BATCH_BYTES = 1 << 20
#: Words that a worker remembers with their pieces; longer words are encoded each time. Forgetting costs time only.
MOST_WORDS = 200_000
LONGEST_WORD = 64
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def spelled(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and lengths by id, and the decimal ids followed by a comma, a bar or a semicolon."""
    tokens = np.empty(len(table), object)
    tokens[:] = table
    written = np.array([[b"%d%c" % (i, end) for i in range(len(table))] for end in b",|;"], object)
    return tokens, np.array([len(x) for x in table], np.int64), written


class ByteSide:
    """Ids of the byte-level vocabulary in the library's file at `path`."""

    def __init__(self, path: str) -> None:
        self.counter = Counter(path)
        self.counter.library.encode_special_tokens = True
        symbols = byte_of_symbol()
        vocabulary = self.counter.library.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, id in vocabulary.items():
            table[id] = token.encode() if token in self.counter.special else bytes(symbols[c] for c in token)
        self.tokens, self.lengths, self.written = spelled(table)

    def ids(self, text: str) -> list[int]:
        if SETTLED.search(text):
            return self.counter.library.encode(text, add_special_tokens=False).ids
        return self.counter.fast.encode_ordinary(text)


class PieceSide:
    """Ids of the sentence-piece model at `path`.

    Where no piece goes on with a space after another character, pieces don't reach over the start of a run of spaces, so
    texts are encoded by such units and each frequent unit once.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        table = []
        for piece in proto.pieces:
            hexadecimal = BYTE_PIECE.fullmatch(piece.piece) if piece.type == piece.BYTE else None
            table.append(bytes.fromhex(hexadecimal[1]) if hexadecimal else piece.piece.replace(SPACE, " ").encode())
        self.tokens, self.lengths, self.written = spelled(table)
        rules = proto.normalizer_spec
        self.by_unit = (
            proto.trainer_spec.model_type == proto.trainer_spec.BPE and rules.name == "identity" and rules.add_dummy_prefix
            and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces)
            and all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p.piece) for p in proto.pieces)
        )
        self.known: dict[str, list[int]] = {}

    def of_unit(self, unit: str) -> list[int]:
        found = self.known.get(unit)
        if found is None:
            rest = unit[1:].replace(SPACE, " ")
            # The library gives nothing for an empty string, but a space for one at the end of a text.
            found = self.library.encode(rest) if rest else [self.library.piece_to_id(SPACE)]
            if len(unit) <= LONGEST_WORD:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                self.known[unit] = found
        return found

    def ids(self, text: str) -> list[int]:
        if not self.by_unit:
            return self.library.encode(text)
        return list(chain.from_iterable(map(self.of_unit, UNIT.findall(SPACE + text.replace(" ", SPACE)))))


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For the tokens of A, then of B, with these ends: the place in B of the last token of their group."""
    n = len(a_ends)
    to = np.empty(n + len(b_ends), np.int64)
    to[:n] = n + np.searchsorted(b_ends, a_ends - 1, side="right")
    over = np.searchsorted(a_ends, b_ends - 1, side="right")
    own = np.arange(n, len(to))
    to[n:] = np.where(a_ends[over] > b_ends, over, own)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to - n
        to = further


def aligned_texts(a: ByteSide, b: PieceSide, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """For each text: counts (tokens of A, of B, groups), the links (ids of A, then those of B), the groups as written."""
    counts = np.zeros((len(texts), 3), np.int64)
    links, groups = [b""] * len(texts), [b""] * len(texts)
    usable, a_parts, b_parts = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = f" {text}"
        data = whole.encode()
        one, two = np.array(a.ids(whole), np.int64), np.array(b.ids(text), np.int64)
        if b"".join(a.tokens[one].tolist()) == data and b"".join(b.tokens[two].tolist()) == data:
            usable.append(i)
            a_parts.append(one)
            b_parts.append(two)
    if not usable:
        return counts, links, groups
    a_ids, b_ids = np.concatenate(a_parts), np.concatenate(b_parts)
    a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    last = terminals(a_ends, b_ends)
    closing = np.flatnonzero(last[len(a_ids) :] == np.arange(len(b_ids)))
    number = np.empty(len(b_ids), np.int64)
    number[closing] = np.arange(len(closing))
    of_a, of_b = number[last[: len(a_ids)]], number[last[len(a_ids) :]]
    linked_a = np.searchsorted(a_ends, b_ends[closing])

    # Tokens as written: those of A before those of B in each group.
    a_in, b_in = np.bincount(of_a, minlength=len(closing)), np.bincount(of_b, minlength=len(closing))
    a_at = np.arange(len(a_ids)) + (np.cumsum(b_in) - b_in)[of_a]
    b_at = np.arange(len(b_ids)) + np.cumsum(a_in)[of_b]
    written = np.empty(len(a_ids) + len(b_ids), object)
    ends_a, ends_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    ends_a[np.cumsum(a_in) - 1] = 1
    ends_b[closing] = 2
    written[a_at] = a.written[ends_a, a_ids]
    written[b_at] = b.written[ends_b, b_ids]

    a_to, b_to = np.cumsum([len(x) for x in a_parts]), np.cumsum([len(x) for x in b_parts])
    group_to = np.searchsorted(closing, b_to)
    pairs = np.stack([a_ids[linked_a], b_ids[closing]]).astype("<u4")
    at = before = 0
    for k, i in enumerate(usable):
        counts[i] = len(a_parts[k]), len(b_parts[k]), group_to[k] - before
        links[i] = pairs[:, before : group_to[k]].tobytes()
        before = group_to[k]
        to = int(a_to[k] + b_to[k])
        groups[i] = b"".join(written[at:to].tolist())[:-1]
        at = to
    return counts, links, groups


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """`docs` without the text, with n_a, n_b, n_groups, `links` (32-bit ids of A, then of B) and `groups`.

    `groups` is `a1,a2|b1;a3|b2,b3` with the ids of each group, or its SHA-256 if only a `digest` is wanted. Columns of
    these names are replaced.
    """
    added = ["n_a", "n_b", "n_groups", "links", "groups"]
    rest = [c for c in docs.columns if c != text and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = once("alignment bytes", byte_path, lambda: ByteSide(byte_path))
        b = once("alignment pieces", piece_path, lambda: PieceSide(piece_path))
        for batch in by_bytes(batches, 0, BATCH_BYTES):
            counts, links, groups = aligned_texts(a, b, batch.column(0).to_pylist())
            shown = [(hashlib.sha256(g).hexdigest() if digest and g else g.decode()) for g in groups]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c) for c in counts.T], pa.array(links, pa.binary()), pa.array(shown, pa.string())],
                names=[*rest, *added],
            )

    long = F.lit(0).cast("long")
    kept = [F.col(f"`{c}`") for c in rest]
    shape = docs.select(*kept, *[long.alias(c) for c in added[:3]], F.lit(b"").alias("links"), F.lit("").alias("groups")).schema
    return docs.select(F.col(f"`{text}`").cast("string").alias(fresh(rest, "text")), *kept).mapInArrow(run, shape)


def ids_of_links(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids as one number each, and how many of them each row has."""
    parts = [np.frombuffer(x, "<u4").astype(np.int64).reshape(2, -1) for x in links.to_pylist()]
    both = np.concatenate([np.empty((2, 0), np.int64), *parts], axis=1)
    return both[0] << 32 | both[1], np.array([p.shape[1] for p in parts], np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (a, b, n): how many links of all texts hold the pair. Counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, n = np.unique(ids_of_links(batch.column(0))[0], return_counts=True)
            codes, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({
            "a": pa.array((codes >> 32).astype(np.int32)), "b": pa.array((codes & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(counts),
        })

    return aligned.select("links").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_pair_counts(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """`aligned` with n_links, n_best (links whose pair is the most frequent of its id of B, ties included) and count_sum
    (of the pairs' counts over the links) in place of `links`. `pairs` is bounded by the vocabularies and broadcast."""
    added = ["n_links", "n_best", "count_sum"]
    rest = [c for c in aligned.columns if c not in ("links", *added)]
    table = pairs.toPandas().astype("int64")
    most = table.groupby("b")["n"].transform("max") if len(table) else table["n"]
    codes = table["a"].to_numpy() << 32 | table["b"].to_numpy()
    order = np.argsort(codes)
    shared = aligned.sparkSession.sparkContext.broadcast(
        (codes[order], table["n"].to_numpy()[order], (table["n"] == most).to_numpy()[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in by_bytes(batches, 0, 4 * BATCH_BYTES):
            found, sizes = ids_of_links(batch.column(0))
            at = np.searchsorted(codes, found)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best, counts)]
            per_row = [s[ends] - s[ends - sizes] for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x) for x in (sizes, *per_row)]], names=[*rest, *added])

    kept = [F.col(f"`{c}`") for c in rest]
    shape = aligned.select(*kept, *[F.lit(0).cast("long").alias(c) for c in added]).schema
    return aligned.select("links", *kept).mapInArrow(run, shape)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """`docs` without the text, with n_a, n_b, n_groups, `groups`, n_links, n_best and count_sum. Texts are read once."""
    aligned = stored(align(docs, byte_path, piece_path, text, digest), "alignment")
    return with_pair_counts(aligned, pair_counts(aligned))
