"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces never cross from a character to a whitespace marker (checked when the codec is built), so a text may be
cut before each run of markers. Each distinct chunk is then segmented once by a worker, and the ids go back to the chunks'
places by gathering from one flat array. Nothing is shuffled: the table lives in the worker, with a bound on its entries.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows stay repeated; which
of two chunks is learnt first decides nothing but their places in the table; an empty table gives no rows; other columns stay
and are never read, but a column named as the result is an error. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import new_column

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A worker hands back results of about so many characters at a time, and its table holds so many chunks.
PIECE_CHARS, TABLE = 1_000_000, 240_000
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


class ChunkCodec:
    """Encodes and decodes whole texts by distinct chunks. ``most``: entries that the table may hold before half of it is forgotten."""

    def __init__(self, model: bytes, most: int = TABLE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())):
            raise ValueError("a piece crosses a whitespace marker; chunks can't be segmented on their own")
        if self.library.normalize("  a  b\n") != f"{MARK * 3}a{MARK * 2}b\n":
            raise ValueError("only models that keep white space, mark it and add one marker in front are supported")
        self.mark = self.library.piece_to_id(MARK)
        if self.mark == self.library.unk_id():
            raise ValueError("the whitespace marker is not a piece")
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.marked = np.array([x.startswith(MARK) for x in pieces])
        self.bare = np.array([x.strip(MARK) == "" for x in pieces])
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.text: list[str] = []
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keeps the half of the table that was learnt first, which has most of the frequent chunks."""
        half = min(self.most // 2, len(self.text))
        self.table = dict(islice(self.table.items(), half))
        self.text, self.start = self.text[:half], self.start[: half + 1]
        self.flat = self.flat[: self.start[-1]]

    def learn(self, chunks: list[str]) -> None:
        """Adds the chunks that the table lacks, segmented in one call: the text made of them is cut where chunks begin."""
        known = self.table
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if not new:
            return
        if known and len(known) + len(new) > self.most:
            self.forget()
            new = [c for c in dict.fromkeys(chunks) if c not in self.table]
        bare = [c for c in new if not c or c[-1] == MARK]  # marks alone would run into the next chunk
        new = [c for c in new if c and c[-1] != MARK]
        parts = [self.segment([c]) for c in bare] + ([self.segment(new)] if new else [])
        sizes = np.concatenate([n for _, n, _ in parts])
        self.start = np.append(self.start, self.start[-1] + np.cumsum(sizes))
        self.flat = np.concatenate([self.flat, *[ids for ids, _, _ in parts]])
        self.table |= {c: i for i, c in enumerate([*bare, *new], len(self.text))}
        self.text += [x for _, _, texts in parts for x in texts]

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of chunks, how many each has, and each chunk's decoded text with the space of its first marker."""
        # The library puts one marker in front by itself; each chunk begins with one.
        plain = [" " + c.replace(MARK, " ") for c in chunks]
        ids = self.library.encode("".join(plain)[1:]) or [self.mark]  # a marker alone: the rest is no text at all
        flat = np.asarray(ids, np.int32)
        if len(chunks) == 1:
            return flat, np.array([len(flat)]), [" " + self.library.decode(ids)]
        first = self.marked[flat]
        first[1:] &= ~self.bare[flat[:-1]]
        sizes = np.diff(np.append(np.flatnonzero(first), len(flat)))
        if len(sizes) != len(chunks) or self.library.decode(ids) != "".join(plain)[1:]:
            done = [self.segment([c]) for c in chunks]
            return np.concatenate([x for x, _, _ in done]), np.concatenate([n for _, n, _ in done]), [y for _, _, x in done for y in x]
        return flat, sizes, plain

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks, each without the first of its markers."""
        if MARK in text or "  " in text or text[-1:] == " " or text[:1] == " ":
            return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def place(self, chunks: list[str]) -> tuple[np.ndarray, str]:
        """Ids and decoded text of a text's chunks, all of which the table has."""
        at = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))
        size = self.start[at + 1] - self.start[at]
        place = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[place], "".join(map(self.text.__getitem__, at.tolist()))[1:]

    def run(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of each; new chunks of all of them are learnt together."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn([c for x in cut for c in x])
        return [self.place(x) for x in cut]


def codec_udf(spark: SparkSession, model_path: str):
    """A column function: text to struct(ids, decoded). The model's bytes (a vocabulary, its size fixed) are broadcast."""
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(model.value)
        for texts in batches:
            some, size = [], 0
            for i, t in enumerate(texts, 1):
                some.append(t)
                size += len(t or "")
                if size > PIECE_CHARS or i == len(texts):
                    done = codec.run(some)
                    yield pd.DataFrame({"ids": [x for x, _ in done], "decoded": [x for _, x in done]})
                    some, size = [], 0

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT).asNondeterministic()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "pieces") -> DataFrame:
    """The rows of docs with a column ``into``: struct(ids array<int>, decoded string)."""
    new_column(docs, into)
    return docs.withColumn(into, codec_udf(docs.sparkSession, model_path)(F.col(text_col)))
