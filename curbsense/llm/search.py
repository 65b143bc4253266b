"""Ranked lexical search: an inverted index in shards, and MaxScore over each shard.

Index: every task turns the documents that it reads into shards of at most SHARD_DOCS documents or
about SHARD_TERMS terms. A shard numbers its documents by ascending id and becomes rows of a table,
one for each term with the documents that hold it and how often, and one row (of the empty term) with
the shard's ids and lengths. Texts aren't shuffled, and no posting list is longer than a shard.

Search: items are taken in blocks that are bounded by their number of terms. The index is reduced to
a block's terms by a join, its counts give the weights, and the postings that are left meet by shard.
In a shard, MaxScore orders an item's terms by upper bound (the highest score that a document of the
shard gets from the term). Terms whose bounds together can't lift a document above the lowest of the
best k so far are non-essential: only documents of the other terms' lists are candidates, and the
non-essential lists are probed from the highest bound down, for the candidates that can still qualify.
Candidates are handled RANGE documents at a time, in arrays. The best k of each shard meet in a window,
which Spark limits to k rows an item before it shuffles them.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbsense.llm.session import python_batches, staged

#: Terms of a text whose A-Z are lower-cased: bytes of digits, letters and all that isn't ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents and terms (with repeats) after which a shard is closed; bound the memory of a task.
SHARD_DOCS, SHARD_TERMS = 16384, 6_000_000
#: Rows of the index written at a time.
ROWS = 20_000
#: Different terms of a block's items together (on average; an item isn't cut). Only they are held by the driver, for one block at a time, and broadcast.
BLOCK_TERMS = 200_000
#: Documents of a shard whose scores are added up at a time.
RANGE = 2048
INDEX = "shard long, term string, df int, total long, docs array<int>, tfs array<int>, ids array<long>"
_NO_SCORES = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


class Shard:
    """The terms of some documents, as numbers, until they are written."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.codes = array("i")
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.codes.extend(map(self.known.__getitem__, terms(text)))
        self.ids.append(doc_id)
        self.ends.append(len(self.codes))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.codes) >= SHARD_TERMS

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows of the index, the one of ids and lengths first."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.diff(np.array([0, *self.ends], dtype=np.int64))
        keys = np.frombuffer(self.codes, dtype=np.int32).astype(np.int64) * len(order) + np.repeat(rank, lengths)
        keys, tfs = np.unique(keys, return_counts=True)
        code, docs = np.divmod(keys, len(order))
        cuts = np.searchsorted(code, np.arange(len(self.known) + 1))
        sums = np.concatenate([[0], np.cumsum(tfs)])
        lists = lambda x, at: pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x[at[0] : at[-1]].astype(np.int32)))
        head = np.array([0, len(order)])
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        yield self._rows(shard, [""], [np.count_nonzero(lengths)], [len(self.codes)], lists(np.arange(len(order)), head), lists(lengths[order], head), ids)
        names = list(self.known)
        for a in range(0, len(names), ROWS):
            at = cuts[a : a + ROWS + 1]
            n = len(at) - 1
            yield self._rows(shard, [x.decode() for x in names[a : a + n]], np.diff(at), sums[at[1:]] - sums[at[:-1]], lists(docs, at), lists(tfs, at), pa.nulls(n, pa.list_(pa.int64())))

    @staticmethod
    def _rows(shard, names, df, total, docs, tfs, ids) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(names), shard)), pa.array(names, pa.string()), pa.array(df, pa.int32()), pa.array(total, pa.int64()), docs, tfs, ids]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "total", "docs", "tfs", "ids"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, shard = TaskContext.get().partitionId() << 24, Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            shard.add(doc_id.as_py(), text.as_py())
            if shard.full():
                yield from shard.batches(number)
                number, shard = number + 1, Shard()
    if shard.ids:
        yield from shard.batches(number)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all terms of df's whole texts, as a staged table (shard, term, df, total, docs, tfs, ids).

    docs are numbers of documents in the shard and tfs how often they hold the term; the row of the
    empty term has the documents' lengths in tfs, their ids in ids, and in df how many hold a term.

    A null, empty or blank text has no terms. A row without id is a document like others, before all
    ids. Repeated rows are documents of their own. A text of any length is read whole. An empty table
    gives no rows; other columns of df are left out and may have any name.
    """
    python_batches(df.sparkSession)
    return staged(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_inverted, INDEX))


class Postings:
    """A term's documents in a shard with what one occurrence of it in an item adds to their scores."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, edges: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.most = int(impacts.max(initial=0))
        self.cuts = np.searchsorted(docs, edges)


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * length * n) div total for each length; of any size, as the product is taken in Python's integers."""
    values, at = np.unique(lengths, return_inverse=True)
    return np.array([25 + 75 * int(x) * n // max(total, 1) for x in values], dtype=np.int64)[at]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best(query: list[tuple[Postings, int]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k documents of highest score above 0, of equal ones the first, with their scores; and how many postings were looked at.

    query holds postings and how often the item has the term.
    """
    lists = sorted(((p.most * times, p, times) for p, times in query if p.most), key=lambda x: x[0])
    bound = np.concatenate([[0], np.cumsum([x[0] for x in lists])]).astype(np.int64)
    docs, scores = _NO_SCORES
    floor, looked = 0, 0
    for r in range(-(-size // RANGE)):
        # Terms before `first` can't lift a document above the floor together: they are non-essential.
        first = int(np.searchsorted(bound[1:], floor, "right"))
        low, sums = r * RANGE, np.zeros(RANGE, dtype=np.int64)
        for _, p, times in lists[first:]:
            part = slice(p.cuts[r], p.cuts[r + 1])
            sums[p.docs[part] - low] += p.impacts[part] * times
            looked += part.stop - part.start
        at = np.flatnonzero(sums)
        for j in range(first - 1, -1, -1):
            at = at[sums[at] + bound[j + 1] > floor]
            if not len(at):
                break
            _, p, times = lists[j]
            part = slice(p.cuts[r], p.cuts[r + 1])
            own = p.docs[part] - low
            if len(own):
                found = np.minimum(np.searchsorted(own, at), len(own) - 1)
                hit = own[found] == at
                sums[at[hit]] += p.impacts[part][found[hit]] * times
                looked += len(at)
        at = at[sums[at] > floor]
        if len(at):
            docs, scores = np.concatenate([docs, at + low]), np.concatenate([scores, sums[at]])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            floor = int(scores[-1]) if len(scores) == k else 0
    return docs, scores, looked


def _searched(items: list[tuple[str, list]], weights: dict[str, int], n: int, total: int, k: int):
    def searched(table: pa.Table) -> pa.Table:
        head = table.filter(pc.equal(table["term"], ""))
        ids = head["ids"].combine_chunks().flatten()
        damp = damping(head["tfs"].combine_chunks().flatten().to_numpy(), n, total)
        edges = np.arange(-(-len(ids) // RANGE) + 1) * RANGE
        known = {}
        for term, docs, tfs in zip(table["term"].to_pylist(), table["docs"], table["tfs"], strict=True):
            if term:
                docs, tfs = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
                known[term] = Postings(docs, weights[term] * (1_000_000_000 * tfs // (1000 * tfs + 8 * damp[docs])), edges)
        item, found, sums = [], [_NO_SCORES[0]], [_NO_SCORES[0]]
        for key, its in items:
            docs, scores, _ = best([(known[t], times) for t, times in its if t in known], len(ids), k)
            item += [key] * len(docs)
            found.append(docs)
            sums.append(scores)
        return pa.table({"item_key": pa.array(item, pa.string()), "doc": ids.take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(sums))})

    return searched


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("item_key"), batch.column("text"), strict=True):
            its = Counter(terms(text.as_py()))
            columns = [pa.array([key.as_py()] * len(its), pa.string()), pa.array([t.decode() for t in its], pa.string()), pa.array(its.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_key", "term", "times"])


def search(postings: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", k: int = 10) -> DataFrame:
    """Rows (item_col, rank, id_col, score): for each item the k documents of the index with the highest score above 0, of equal ones those of smaller id first.

    With N documents that hold a term, L terms in all, n in a document, df documents that hold a term
    and tf occurrences of it, the score adds w * ((10**9 * tf) div (1000 * tf + 8 * m)) for every term
    of the item, repeats included, where w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and
    m = 25 + (75 * n * N) div L.

    Items of null or empty texts, and all items where the index is empty, get no rows. Rows that
    repeat an item are one; an id with several texts is an item for each. Documents without id come
    before others of their score. Items of any length are taken whole. Other columns of items are left
    out and may have any name.
    """
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    asked = staged(asked.withColumn("item_key", F.sha2(F.to_json(F.struct("item", "text")), 256)))
    its = staged(asked.select("item_key", "text").mapInArrow(_item_terms, "item_key string, term string, times long"))
    heads = postings.where("term = ''")
    n, total = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = max(1, math.ceil(its.count() / BLOCK_TERMS))
    found = []
    for b in range(blocks):
        mine = its.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == b)
        own = postings.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")
        weights = {r.term: weight(n, r.df) for r in own.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        queries = defaultdict(list)
        for r in mine.toLocalIterator():
            if r.term in weights:
                queries[r.item_key].append((r.term, r.times))
        rows = own.unionByName(heads).groupBy("shard").applyInArrow(_searched(sorted(queries.items()), weights, n, total, k), "item_key string, doc long, score long")
        found.append(staged(rows))
    order = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item_key", "item"), "item_key").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


#: The same by all pairs of items and documents that share a term.
ORACLE_SQL = r"""
WITH lower_az AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM lower_az),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM held GROUP BY ALL),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM (SELECT DISTINCT r, n FROM tf)),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN weight USING (term) JOIN tf USING (term), size GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
