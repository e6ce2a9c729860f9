"""Ranked lexical search by a document FP-tree.

Every document becomes a vector of the benchmark's terms only, in the order of their document frequency, rare ones first. A task
builds trees of TREE_DOCS vectors: vectors that begin alike share a path, so a subtree is a run of the sorted vectors. A node
holds the largest tf of each term below it and the smallest m, which bound every score below it: a score grows with tf and
falls with m. The search goes depth first, the most promising child first, and an item leaves a subtree whose bound doesn't
reach its tenth score so far; at a single vector the bound is the score itself. All items walk the tree together, each
with its own threshold, which it keeps from tree to tree of a task. Each task hands on ten rows an item at most, and the best of all tasks
are found by rank, in two steps.

Items come in blocks of bounded size, whose terms and weights are all that is broadcast; more items make more blocks, each a
pass over the documents' vectors.

Defined cases: a text or item that is null or has no terms matches nothing (the text isn't counted in N); repeated terms of an item count
repeatedly; rows that repeat an item (id and text) are one item, other texts under its id are ranked apart; rows that repeat a doc_id
are documents of their own; equal scores go by ascending doc_id, null first; long texts are read whole; other columns
aren't carried; no documents or no items give no rows. Document and item ids are whole numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, stored
from .words import list_array, owner, release, slices, split

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: What each byte of UTF-8 becomes before the text is cut at spaces: only A-Z are lowered, what is no letter or digit of ASCII separates.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
#: Items of a block, and their terms with repeats: a block's tables take a few MB.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 100_000
#: Vectors of a tree, and entries of them: a longer vector is a tree of its own.
TREE_DOCS, TREE_ENTRIES = 8_192, 2_000_000
#: Items that are still open at a node are scored one by one if they are so few.
FEW = 6
NO_ID = -(2**63)
SALTS = 64


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, only A-Z lower-cased."""
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_bytes(texts: pa.Array) -> pa.Array:
    """The texts with separators as spaces and A-Z lower-cased, byte by byte."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return texts
    data = BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])


def count_terms(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of each document that has any, and those of the vocabulary (by place) with their
    tf."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, 1):
            codes, distinct, starts = split(plain_bytes(part.column(1)))
            lengths = np.diff(starts)
            place = pc.fill_null(pc.index_in(distinct.cast(pa.string()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = place[codes] if len(codes) else np.empty(0, np.int64)
            doc = owner(starts)
            keys, tfs = np.unique((doc * len(known) + at)[at >= 0], return_counts=True)
            doc, at = np.divmod(keys, max(1, len(known)))
            many = np.bincount(doc, minlength=len(lengths))
            some = pa.array(lengths > 0)
            made = [part.column(0), pa.array(lengths, pa.int64()), list_array(pa.array(at, pa.int32()), many), list_array(pa.array(tfs, pa.int32()), many)]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in made], ["doc_id", "n", "terms", "tfs"])
            release()

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<int>")


def part_score(tf: np.ndarray, m) -> np.ndarray:
    """A term's share of a score before its weight; grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def greatest(terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and the largest tf of each."""
    order = np.argsort(terms, kind="stable")
    terms, tfs = terms[order], tfs[order]
    heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
    return terms[heads], np.maximum.reduceat(tfs, heads) if len(heads) else tfs


class Items:
    """A block's items: the terms (by rank) and the weights of each, repeats summed."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], width: int):
        self.terms, self.weights, self.width = terms, weights, width
        self.flat, self.flat_weights = np.concatenate(terms), np.concatenate(weights)
        self.starts = np.cumsum([0] + [len(t) for t in terms[:-1]])

    def __len__(self) -> int:
        return len(self.terms)

    def bounds(self, shares: np.ndarray, open_: np.ndarray) -> np.ndarray:
        if len(open_) <= FEW:
            return np.array([int(self.weights[i] @ shares[self.terms[i]]) for i in open_.tolist()], np.int64)
        return np.add.reduceat(self.flat_weights * shares[self.flat], self.starts)[open_]


class Best:
    """The best rows of every item so far, as (score, doc_id)."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score of 0 is none

    def offer(self, item: int, score: int, ids: list[int]) -> None:
        rows = self.rows[item]
        rows += [(score, d) for d in ids]
        rows.sort(key=lambda r: (-r[0], r[1]))
        del rows[self.k :]
        if len(rows) == self.k:
            self.least[item] = rows[-1][0]


class Tree:
    """An FP-tree over sorted vectors. Node: (first vector, stop, children or None, terms, their largest tf, smallest m)."""

    def __init__(self, ids: list[int], ms: list[int], terms: list[np.ndarray], tfs: list[np.ndarray], k: int):
        paths = [t.tobytes() for t in (x.astype(">i4") for x in terms)]  # bytes that sort as the terms do
        order = sorted(range(len(ids)), key=lambda i: (paths[i], tfs[i].tobytes(), ms[i], ids[i]))
        self.leaves, ends = [], []
        for i in order:
            if ends and paths[ends[-1]] == paths[i] and ms[ends[-1]] == ms[i] and np.array_equal(tfs[ends[-1]], tfs[i]):
                if len(self.leaves[-1]) < k:  # of equal vectors, those of larger ids rank behind
                    self.leaves[-1].append(ids[i])
            else:
                ends.append(i)
                self.leaves.append([ids[i]])
        shared = [self.common(terms[a], terms[b]) for a, b in zip(ends, ends[1:])]
        leaf = lambda v: (v, v + 1, None, terms[ends[v]], tfs[ends[v]], ms[ends[v]])
        # Open paths, from the root on: (shared terms, children). A neighbour that shares fewer terms closes the deeper ones.
        open_: list[tuple[int, list]] = [(-1, [leaf(0)])] if ends else [(-1, [])]
        for v, depth in enumerate(shared, 1):
            last = open_[-1][1].pop()
            while open_[-1][0] > depth:
                _, children = open_.pop()
                last = self.node([*children, last])
            if open_[-1][0] < depth:
                open_.append((depth, []))
            open_[-1][1].append(last)
            open_[-1][1].append(leaf(v))
        while len(open_) > 1:
            _, children = open_.pop()
            open_[-1][1].append(self.node(children))
        self.root = self.node(open_[0][1]) if open_[0][1] else None

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        same = a[:n] == b[:n]
        return n if same.all() else int(same.argmin())

    @staticmethod
    def node(children: list[tuple]) -> tuple:
        if len(children) == 1:
            return children[0]
        terms, tfs = greatest(np.concatenate([c[3] for c in children]), np.concatenate([c[4] for c in children]))
        return children[0][0], children[-1][1], children, terms, tfs, min(c[5] for c in children)

    def search(self, items: Items, best: Best) -> int:
        """Offers what may be among the best; gives how many nodes were looked at."""
        shares = np.zeros(items.width, np.int64)

        def bounds(node: tuple, open_: np.ndarray) -> np.ndarray:
            shares[node[3]] = part_score(node[4].astype(np.int64), node[5])
            found = items.bounds(shares, open_)
            shares[node[3]] = 0
            return found

        seen, todo = 0, []
        if self.root is not None:
            every = np.arange(len(items))
            todo = [(self.root, every, bounds(self.root, every))]
        while todo:
            node, open_, bound = todo.pop()
            hopeful = bound >= best.least[open_]
            open_, bound = open_[hopeful], bound[hopeful]
            seen += 1
            if not len(open_):
                continue
            if node[2] is None:
                for item, score in zip(open_.tolist(), bound.tolist(), strict=True):
                    best.offer(item, score, self.leaves[node[0]])
                continue
            ahead = [(c, open_, bounds(c, open_)) for c in node[2]]
            ahead.sort(key=lambda x: int(x[2].max()))
            todo += ahead
        return seen


def best_of_parts(vectors: DataFrame, items: Items, order: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score) of every task's k best rows of each item. order: each term's place, rare terms first."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, order))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, order = shared.value
        best, held, entries = Best(len(items), k), [], 0

        def close() -> None:
            nonlocal held, entries
            if held:
                Tree(*map(list, zip(*held, strict=True)), k).search(items, best)
            held, entries = [], 0

        for batch in batches:
            ids = pc.fill_null(batch.column(0), NO_ID).to_pylist()
            ns = batch.column(1).to_numpy(zero_copy_only=False)
            ms = (25 + (75 * ns.astype(object) * total) // length).tolist()
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            terms = order[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            by = np.lexsort((terms, owner(starts)))
            terms, tfs = terms[by], tfs[by]
            for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                if entries + b - a > TREE_ENTRIES or len(held) >= TREE_DOCS:
                    close()
                held.append((ids[i], ms[i], terms[a:b], tfs[a:b]))
                entries += b - a
        close()
        rows = [(i, None if d == NO_ID else d, s) for i, own in enumerate(best.rows) for s, d in own]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
        release()

    some = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    return some.mapInArrow(work, "item int, doc_id long, score long")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Distinct (item_id, text), one bounded block after another on the driver."""
    rows = items.select(named(id_col).cast("long").alias("item_id"), named(text_col).alias("text")).where("text IS NOT NULL").distinct()
    block, size = [], 0
    for r in stored(rows, "items").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        own = terms_of(r.text)
        if not own:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(own) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((r.item_id, own))
        size += len(own)
    if block:
        yield block


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first within parts of the tasks, so no task gets the rows of all."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark, found = docs.sparkSession, []
    for block in item_blocks(items, item_col, item_text_col):
        vocabulary = sorted({t for _, own in block for t in own})
        vectors = stored(count_terms(docs, vocabulary, id_col, text_col), "term-vectors")
        total, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total:
            continue
        # A row a term of the block: a bounded table.
        df = {r.t: r.df for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
        counts = np.array([df.get(i, 0) for i in range(len(vocabulary))])
        order = np.empty(len(vocabulary), np.int64)
        order[np.argsort(counts, kind="stable")] = np.arange(len(vocabulary))
        place = {t: i for i, t in enumerate(vocabulary)}
        terms, weights = [], []
        for _, own in block:
            at, repeats = np.unique([place[t] for t in own], return_counts=True)
            terms.append(order[at])
            weights.append(np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(counts[i]) + 1))) * int(r) for i, r in zip(at, repeats, strict=True)], np.int64))
        rows = stored(best_of_parts(vectors, Items(terms, weights, len(vocabulary)), order, total, length, k), "found")
        ids = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long"))
        found.append(_ranked(rows, k).join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
