"""Packing tokenised documents into fixed windows, best-fit decreasing."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnmart.llm.common import col, cut, ship, table

WINDOW = 1024
END_ID = 0
GROUP_PIECES = 16_384  # tails that one task packs, in expectation
CHUNK_CHARS = 1 << 18  # longer texts are tokenised in chunks
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # its vocabulary as ranks
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The tokens a tokenizer file adds to its vocabulary: wherever one stands in a text, it is one id and words end there."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    for token in found:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")) or _CUT.search(token["content"]):
            raise ValueError(f"added token {token['content']!r} is not matched as it stands")
    return tuple((token["content"], token["id"]) for token in found)


@lru_cache(maxsize=2)
def _encoding(path: str, added: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


def text_parts(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """A long text in parts that tokenise to the same ids: cut before a blank between a non-blank and a letter,
    where the pre-tokenizer always starts a word."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def token_ids(text: str, path: str, added: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    """The ids of a whole text; strings of ``added`` tokens are those tokens."""
    encoding = _encoding(path, added)
    return np.concatenate([np.asarray(encoding.encode(part, allowed_special="all"), "<u4") for part in text_parts(text)])


def pieces_of(batches: Iterator[pa.RecordBatch], window: int, end_id: int, path: str,
              added: tuple[tuple[str, int], ...] = ()) -> Iterator[pa.RecordBatch]:
    """Documents cut into full windows and one tail; every piece has a number of its own, the same in a repeated task."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows, out = [], []
        for row, text in enumerate(batch.column("text")):
            ids = np.append(token_ids(text.as_py() or "", path, added), np.uint32(end_id)).astype("<u4")
            for at in range(0, len(ids), window):
                part = ids[at:at + window]
                rows.append(row)
                out.append((at, len(part), zlib.crc32(part.tobytes()), len(ids), number))
                number += 1
        columns = np.array(out, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, columns)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts those with c tokens of room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()  # at least window + 1
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, number: int) -> None:
        if room:
            self.stacks[room].append(number)
            self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Room and number of the open window with the least room of at least ``length``; it is taken out."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node & 1 or not count[node ^ 1]:  # up until a right neighbour has windows
                node >>= 1
                if node <= 1:
                    return None
            node ^= 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        number = self.stacks[room].pop()
        self._add(room, -1)
        return room, number


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length, the longest placed first, each in the tightest open window."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = windows.tightest(length)
        if found is None:
            room, number = window, opened
            opened += 1
        else:
            room, number = found
        place[i], offset[i] = number, window - room
        windows.put(room - length, number)
    return place, offset


def pack_group(tails: pa.Table, window: int) -> pa.Table:
    """Tails of one group with their window and offset."""
    tails = tails.sort_by("piece")  # the order of arrival differs between runs
    lengths = tails.column("length").to_numpy()
    place, offset = best_fit(lengths, window)
    used = np.bincount(place, weights=lengths).astype(np.int64)
    padded = np.where(used & (used - 1), window, used)
    group = tails.column("group").to_numpy()
    sequence = -1 - (group << 31 | place)  # below zero; full windows have their piece's number
    return pa.table([*tails.select(NAMES).columns, sequence, offset, padded[place]], [*NAMES, *PLACED])


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PLACED = ["sequence_id", "offset", "padded_length"]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         vocabulary: str | None = None, group_pieces: int = GROUP_PIECES, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document is its ids and ``end_id``; a null or empty text is that id alone.
    Ids are those of the file ``tokenizer``, whose vocabulary ``vocabulary`` has
    as ranks; tokens it adds (an end mark) are single ids wherever a text has them.
    Full windows are sequences by themselves.  Tails meet in groups of about
    ``group_pieces``, dealt by the number they have in the written table, so
    many equal ids or texts do not meet in one task; each group is packed
    best-fit decreasing.  A sequence of a power of two tokens needs no padding.
    Repeated rows and null ids are documents of their own, other columns are not
    looked at, no rows give none.
    """
    ship(docs.sparkSession)
    path, added = vocabulary or public_tokenizers.path(RANKS), added_tokens(tokenizer or public_tokenizers.path(TOKENIZER))
    rows = docs.select(col(id_col).alias("doc_id"), col(text).alias("text"))
    longs = [T.StructField(name, T.LongType()) for name in [*NAMES[1:], "piece"]]
    written = T.StructType([rows.schema["doc_id"], *longs])
    pieces = cut(rows.mapInArrow(lambda it: pieces_of(it, window, end_id, path, added), written), "pieces")
    full = pieces.filter(F.col("length") == window).select(
        *NAMES, F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("padded_length"))
    tails = pieces.filter(F.col("length") < window)
    groups = -(-tails.count() // group_pieces) or 1
    dealt = tails.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    schema = T.StructType([*written[:-1], *[T.StructField(name, T.LongType()) for name in PLACED]])
    return full.union(dealt.groupBy("group").applyInArrow(lambda t: pack_group(t, window), schema))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
