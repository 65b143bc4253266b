"""Substring deduplication: words covered by a window that starts earlier elsewhere are removed.

Documents are dealt into blocks of about BLOCK bytes by a hash, and three passes run over them:

1. Each block sketches its windows: two rows of a count-min sketch, whose cells are kept as sorted
   cell numbers with counts up to 2. The sketch is as wide as the corpus is long and is cut into
   parts; the blocks' sketches of a part are merged in one task, and each block is told, one bit for
   each cell it sent, whether the merged count is 2 or more. Merged counts can only be too high.
2. Each block sends the windows whose two cells both say "repeated", the first of equal ones only,
   with 96-bit keys and their places, dealt by key. Equal keys meet, and all but the first place are
   sent back. No repeated window is missed, and hot windows cost one row a block at most.
3. Each block marks the windows sent back and those repeated inside it, and drops the words covered.

The blocks are shuffled once and read by all three passes. What crosses the network otherwise is a
few bytes a window: sketches as cell numbers of a byte or two, verdicts as bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbsense.llm.session import python_batches
from curbsense.llm.wordhash import U64, WINDOW2, WORD2, Words, mix

#: Bytes of text in a block, least and most cells of a part of the sketch (powers of 2; a byte of memory each), cells of a row for each byte of the corpus.
BLOCK, PART, PART_MOST, CELLS = 8 << 20, 1 << 25, 1 << 28, 1.25
#: Parts of a sketch that a corpus has before its parts get wider.
PARTS = 64
SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
#: Stands for a null id, which sorts first.
NULL_ID = -(1 << 63)


def pack(numbers: np.ndarray) -> bytes:
    """Sorted different numbers below 2**32: low bits as they are, high bits as gaps in a bitmap."""
    n, top = len(numbers), int(numbers[-1]) + 1 if len(numbers) else 1
    wide = top > 2000 * max(n, 1)
    shift, low = (16, "<u2") if wide else (8, "u1")
    x = numbers.astype(np.int64)
    bits = np.zeros((top >> shift) + n + 1, dtype=bool)
    bits[(x >> shift) + np.arange(n)] = True
    return bytes([shift]) + np.int64(n).tobytes() + (x & ((1 << shift) - 1)).astype(low).tobytes() + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    shift, n = data[0], int(np.frombuffer(data, dtype=np.int64, count=1, offset=1)[0])
    low = np.frombuffer(data, dtype="<u2" if shift == 16 else "u1", count=n, offset=9).astype(np.int64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=9 + n * (shift // 8))))[:n] - np.arange(n)
    return (high << shift) | low


class Block:
    """The documents of a block by id, and their windows; the same in each pass, whatever order rows come in."""

    def __init__(self, table: pa.Table, window: int):
        # Columns by place: the first is the group's key.
        ids, text = table.column(1).combine_chunks(), table.column(2).combine_chunks()
        order = pc.sort_indices(pa.table({"id": ids, "text": text}), sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.ids = ids.take(order)
        self.places = self.ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.words, self.window = Words(text.take(order)), window
        self.starts = self.words.window_starts(window)
        self.keys = self.words.windows(self.words.hashes(), self.starts, window)
        #: Windows base[d] .. base[d + 1] - 1 are those of document d.
        self.base = np.concatenate([[0], np.cumsum(np.maximum(np.diff(self.words.first) - window + 1, 0))])

    def cells(self, row: int, parts: int, part: int) -> np.ndarray:
        """The cell of each window in a row of the sketch: its part's number * part + its number there."""
        value = mix(self.keys ^ U64(SEEDS[row]))
        return ((value >> U64(32)) % U64(parts)) * U64(part) + (value & U64(part - 1))

    def second_keys(self, windows: np.ndarray) -> np.ndarray:
        """32 more bits of the keys of some windows (sorted)."""
        if not len(windows):
            return np.zeros(0, dtype=np.uint32)
        return (self.words.windows(self.words.hashes(WORD2), self.starts[windows], self.window, WINDOW2) >> U64(32)).astype(np.uint32)

    def doc_of(self, windows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, windows, "right") - 1


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(sorted_keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _sketch(window: int, parts: int, size: int):
    def sketch(table: pa.Table) -> pa.Table:
        block, out = Block(table, window), {"part": [], "block": [], "cells": [], "twice": []}
        for row in range(2):
            cells, counts = np.unique(block.cells(row, parts, size), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(parts + 1, dtype=U64) * U64(size))
            for part in np.flatnonzero(np.diff(cuts)):
                mine = slice(cuts[part], cuts[part + 1])
                out["part"].append(row * parts + int(part))
                out["block"].append(table.column(0)[0].as_py())
                out["cells"].append(pack(cells[mine] - U64(int(part) * size)))
                out["twice"].append(np.packbits(counts[mine] > 1).tobytes())
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())]))

    return sketch


def _merged(size: int):
    def merged(table: pa.Table) -> pa.Table:
        """The merged counts of one part, as bits for the cells that each block has sent."""
        counts, bits = np.zeros(size, dtype=np.uint8), []
        for cells, twice in zip(table["cells"], table["twice"], strict=True):
            at = unpack(cells.as_py())
            own = 1 + np.unpackbits(np.frombuffer(twice.as_py(), dtype=np.uint8), count=len(at))
            counts[at] = np.minimum(counts[at] + own, 2)
        for cells in table["cells"]:
            bits.append(np.packbits(counts[unpack(cells.as_py())] > 1).tobytes())
        return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array(bits, pa.binary())})

    return merged


def _candidates(window: int, parts: int, size: int):
    def candidates(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(docs, window)
        found = {p: b for p, b in zip(told["part"].to_pylist(), told["bits"].to_pylist(), strict=True)}
        live = np.arange(len(block.keys))
        for row in range(2):
            every = block.cells(row, parts, size)
            cells = np.unique(every)
            cuts = np.searchsorted(cells, np.arange(parts + 1, dtype=U64) * U64(size))
            flags = [np.unpackbits(np.frombuffer(found[row * parts + int(p)], dtype=np.uint8), count=cuts[p + 1] - cuts[p]) for p in np.flatnonzero(np.diff(cuts))]
            if flags:
                live = live[np.concatenate(flags)[np.searchsorted(cells, every[live])] > 0]
        keys, more = block.keys[live], block.second_keys(live)
        order = np.lexsort((more, keys))  # stable: places stay in order
        first = np.sort(order[_runs(keys[order], more[order])]) if len(live) else order
        live, keys, more = live[first], keys[first], more[first]
        bucket = ((keys >> U64(32)) % U64(2 * parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(2 * parts + 1))
        out = {c: [] for c in ("bucket", "block", "windows", "keys", "more", "docs", "base", "count")}
        for b in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[b] : cuts[b + 1]]
            doc, count = np.unique(block.doc_of(live[mine]), return_counts=True)
            columns = (pack(live[mine]), keys[mine], more[mine], block.places[doc], block.base[doc], count.astype(np.uint32))
            for name, value in zip(("windows", "keys", "more", "docs", "base", "count"), columns, strict=True):
                out[name].append(value if isinstance(value, bytes) else value.tobytes())
            out["bucket"].append(int(b))
            out["block"].append(docs.column(0)[0].as_py())
        schema = [("bucket", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("windows", "keys", "more", "docs", "base", "count")]
        return pa.table(out, schema=pa.schema(schema))

    return candidates


def _later(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, exactly grouped, those that are not first, for each block."""
    rows = [{c: table[c][i].as_py() for c in table.column_names} for i in range(table.num_rows)]
    windows = [unpack(r["windows"]) for r in rows]
    count = [np.frombuffer(r["count"], dtype=np.uint32) for r in rows]
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], dtype=kind) for r in rows])
    keys, more = join("keys", U64), join("more", np.uint32)
    doc = np.repeat(join("docs", np.int64), np.concatenate(count))
    start = np.concatenate(windows) - np.repeat(join("base", np.int64), np.concatenate(count))
    order = np.lexsort((start, doc, more, keys))
    runs = _runs(keys[order], more[order])
    head = np.repeat(order[runs], np.diff(np.append(runs, len(order))))
    late = np.zeros(len(order), dtype=bool)
    late[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    cuts = np.cumsum([0, *map(len, windows)])
    return pa.table({"block": table["block"], "late": pa.array([pack(w[late[a:b]]) for w, a, b in zip(windows, cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _kept(window: int, id_name: str, with_text: bool):
    def kept(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(docs, window)
        late = np.zeros(len(block.keys), dtype=bool)
        for x in told["late"]:
            late[unpack(x.as_py())] = True
        # Windows repeated inside the block; those at the place of the first (a repeated row) share its verdict.
        order = np.argsort(block.keys, kind="stable")
        runs = _runs(block.keys[order])
        size = np.diff(np.append(runs, len(order)))
        again = np.sort(order[np.repeat(size > 1, size)])
        more = block.second_keys(again)
        by_key = np.lexsort((more, block.keys[again]))
        order = again[by_key]
        runs = _runs(block.keys[order], more[by_key])
        head = np.repeat(order[runs], np.diff(np.append(runs, len(order)))) if len(order) else order
        d, e = block.doc_of(order), block.doc_of(head)
        same = (block.places[d] == block.places[e]) & (order - block.base[d] == head - block.base[e])
        late[order] = late[order] | ~same | late[head]

        w = block.words
        change = np.zeros(len(w.starts) + 1, dtype=np.int64)
        at = block.starts[np.flatnonzero(late)]
        change[at] += 1  # starts are different, so each place is added to once
        change[at + window] -= 1
        stay = np.cumsum(change[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(stay)])
        n, n_left = np.diff(w.first), left[w.first[1:]] - left[w.first[:-1]]
        digests, texts = [], []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            keep = np.arange(a, b)[stay[a:b]]
            text = _joined(w.data, w.starts[keep], w.ends[keep])
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode("utf-8"))
        out = {id_name: block.ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - n_left, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return kept


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words data[start:end], joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    cuts = np.cumsum(sizes)
    at = np.arange(cuts[-1]) + np.repeat(starts - (cuts - sizes), sizes)
    at[-1] = starts[0]
    out = data[np.minimum(at, len(data) - 1)]
    out[cuts - 1] = 32
    return out[:-1].tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False, block_bytes: int = BLOCK, part_cells: int = PART) -> DataFrame:
    """One row per row of df: its id, n_words, n_removed, kept_sha256 and, with_text, kept_text.

    A word goes if a window of `window` consecutive words of its document covers it whose word
    sequence also starts earlier: in a document of smaller id, or before in the same. Windows are
    judged on the input. A null text has no words; a document of fewer words has no window. A null
    id counts as smaller than all. Rows that repeat an id stand at the same place: equal windows at
    equal starts of them do not remove one another. Texts of any length are read whole. An empty
    table gives no rows; other columns of df are left out and may have any name.

    A part of the sketch gets wider with the corpus, from part_cells up to PART_MOST, so that a block
    sends its windows in few rows for as long as memory allows.
    """
    python_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    while part_cells < PART_MOST and size * CELLS > part_cells * PARTS:
        part_cells *= 2
    blocks, parts = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size * CELLS / part_cells))
    docs = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "text")
    own = docs.groupBy("block")
    sketches = own.applyInArrow(_sketch(window, parts, part_cells), "part int, block long, cells binary, twice binary")
    told = sketches.groupBy("part").applyInArrow(_merged(part_cells), "block long, part int, bits binary")
    fields = "bucket int, block long, windows binary, keys binary, more binary, docs binary, base binary, count binary"
    near = own.cogroup(told.groupBy("block")).applyInArrow(_candidates(window, parts, part_cells), fields)
    late = near.groupBy("bucket").applyInArrow(_later, "block long, late binary")
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return own.cogroup(late.groupBy("block")).applyInArrow(_kept(window, id_col, with_text), schema)
