"""Token counts with a public byte-level BPE vocabulary.

Texts are encoded in Arrow batches of about equal bytes and only lengths leave the function. Texts longer than a piece
are split where no token can lie across: before a space between a visible character and a letter.

The vocabulary is the library's .json file. Its merges are in the order of its ids, so the ranks of the faster encoder
are the ids themselves; texts with characters whose class may depend on the Unicode version go to the library itself.
Both read the file where the executor has it. Null and empty texts have no tokens. Special strings in a text are what
the library's default makes of them: one token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwise.llm.common import by_bytes, once

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
SAFE = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
# Latin letters, their punctuation and quotation marks have had their classes since long.
SETTLED = re.compile("[^\x00-ɏ‐-‧]")


def byte_of_symbol() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens of texts as the library does with the vocabulary at `path`."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        symbols = byte_of_symbol()
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        ranks = {
            bytes(symbols[c] for c in token): id for token, id in content["model"]["vocab"].items() if token not in special
        }
        self.fast = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = sorted(special)

    def counts(self, pieces: list[str]) -> list[int]:
        out = [0] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if SETTLED.search(piece):
                rest.append(i)
            elif any(x in piece for x in self.special):
                out[i] = len(self.fast.encode(piece, allowed_special="all"))
            else:
                out[i] = len(self.fast.encode_ordinary(piece))
        if rest:
            for i, found in zip(rest, self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
                out[i] = len(found)
        return out


def pieces_of(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe boundaries into pieces of about `most` characters, or longer where there is none."""
    pieces, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def count_tokens(docs: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """`docs` with `count` in place of the text; a column of that name is replaced."""
    rest = [c for c in docs.columns if c not in (text, count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("count tokens", path, lambda: Counter(path))
        for batch in by_bytes(batches, 0, BATCH_BYTES):
            pieces, owner = [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                if value:
                    parts = pieces_of(value)
                    pieces += parts
                    owner += [i] * len(parts)
            totals = [0] * batch.num_rows
            for i, n in zip(owner, counter.counts(pieces)):
                totals[i] += n
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(totals, pa.int64())], names=[*rest, count])

    chosen = docs.select(F.col(f"`{text}`").cast("string").alias(text), *[f"`{c}`" for c in rest])
    return chosen.mapInArrow(run, docs.select(*[f"`{c}`" for c in rest], F.lit(0).cast("long").alias(count)).schema)
