"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of text the table keeps the one token that the prefix's encoding ends
with. A token may follow another only where BPE leaves their concatenation as those two tokens, and
exactly one token of a prefix passes that test, so the table is filled left to right and read off
from its end. Appending needs only the new entries; after an edit the entries before it stay, and
those behind it are taken over once the table agrees with the old one again.

Ranks and pattern are parameters: a file of base64 tokens with ranks, and the expression whose
matches are encoded separately. No special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbsense.llm.session import python_batches

#: Pieces, pairs of tokens and shared tables that a worker remembers (some 130 MB); beyond, it starts afresh.
PIECES, PAIRS, TABLES = 250_000, 300_000, 100_000
#: Lengths of beginnings whose prefix tables are shared, longest first.
HEADS = (11, 9, 7, 5)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens that BPE makes of their own bytes; the only ones an encoding can hold.
        self.stable = {token: rank for token, rank in ranks.items() if self.merged(token) == [rank]}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        #: Beginnings of HEADS bytes -> the last tokens of their prefixes.
        self.heads: dict[bytes, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: merge the pair of least rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < 1 << 60:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [self.ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append to `last`, the last tokens of the prefixes of data so far, that of the next longer prefix.

        Of the tokens that a prefix ends with, the one that may follow the encoding before it: BPE
        of both tokens' bytes is the two tokens. There is exactly one, so any order of trial finds
        it; often it is the last token so far with one byte more.
        """
        get, pairs, end = self.stable.get, self._pairs, len(last)
        longer = end - 1 - self.sizes[last[-1]] if end > 1 else 0
        for start in (longer, *range(end - 1, max(-1, end - 1 - self.longest), -1)):
            token = get(data[start:end])
            if token is None:
                continue
            if start:
                key = last[start] << 32 | token
                follows = pairs.get(key)
                if not (self._follows(key) if follows is None else follows):
                    continue
            last.append(token)
            return
        raise ValueError(f"no token ends at byte {end}")

    def _follows(self, key: int) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        left, right = key >> 32, key & 0xFFFFFFFF
        follows = self._pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return follows


class PrefixTable:
    """The last token of every prefix of `data`."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        # Prefixes depend on their own bytes alone, so tables of common beginnings are shared.
        heads, known = vocabulary.heads, next((h for n in HEADS if (h := vocabulary.heads.get(data[:n]))), (-1,))
        self.last = list(known) if len(known) <= len(data) + 1 else [-1]
        for _ in range(len(self.last), len(data) + 1):
            vocabulary.extend(data, self.last)
        for n in HEADS:
            if len(known) - 1 < n <= len(data):
                if len(heads) >= TABLES:
                    heads.clear()
                heads[data[:n]] = tuple(self.last[: n + 1])

    def append(self, data: bytes) -> None:
        """Add bytes at the end; entries so far stay."""
        self.data += data
        for _ in data:
            self.vocabulary.extend(self.data, self.last)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Put `data` in place of data[start:stop]. Returns how many entries were computed anew."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last, agree = old[: start + 1], 0
        for end in range(start + 1, len(self.data) + 1):
            # An entry depends on the bytes and entries of one longest token before it.
            if agree >= self.vocabulary.longest:
                self.last += old[end - shift :]
                return end - start - 1
            self.vocabulary.extend(self.data, self.last)
            agree = agree + 1 if end > start + len(data) and self.last[end] == old[end - shift] else 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= self.vocabulary.sizes[out[-1]]
        return out[::-1]


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, filled on demand."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        v, data = self.vocabulary, piece.encode("utf-8")
        whole = v.ranks.get(data)
        ids = [whole] if whole is not None else PrefixTable(v, data).ids()
        packed = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Encoder:
    """Texts to ids and back. A piece that is a token itself is that token, as tokenizers of this kind have it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        # White space as Unicode has it, without the control characters that Python adds.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._known = _Pieces(self.vocabulary)
        # All tokens' bytes in a row, and where each begins, for decoding by array operations.
        tokens = [self.vocabulary.tokens.get(i, b"") for i in range(max(self.vocabulary.tokens) + 1)]
        self._sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """The ids of text + more, from those of text: only the last piece of text can change."""
        if not text:
            return self.encode(more)
        last = self.split(text)[-1]
        return ids[: len(ids) - len(self._known[last]) // 4] + self.encode(last + more)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id that is none raises IndexError or stands for nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        return self._bytes[np.repeat(self._starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


    def forget(self) -> None:
        """Drop pieces and shared tables, so that a worker without a task holds little memory."""
        self._known.clear()
        self.vocabulary.heads.clear()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file; read once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id and the ids of its text, array<int>. See round_trip() for special cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(e.packed(t.as_py() or ""), dtype="<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])
        e.forget()

    python_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: its id and the bytes that its ids stand for (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], names=[id_col, "data"])

    python_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` long, data binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of df: its id, n_tokens, ids_sha256 and decoded_sha256, from encoding its text and decoding the ids; with_ids the ids too.

    A null text counts as empty and has no ids. A null id stays null; repeated rows give equal rows;
    an empty table gives none. Texts of any length are encoded whole. Other columns of df are left
    out and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            n, ids_digest, data_digest, ids = [], [], [], []
            for text in batch.column(1):
                packed = e.packed(text.as_py() or "")
                n.append(len(packed) // 4)
                ids_digest.append(hashlib.sha256(packed).hexdigest())
                data_digest.append(hashlib.sha256(e.decode(np.frombuffer(packed, dtype="<u4"))).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(data_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        e.forget()

    python_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
