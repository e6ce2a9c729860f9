"""Substring dedup: words inside a window of fixed length that also starts in a document of a smaller id are removed.

Tasks hash every window by Rabin-Karp: a running polynomial over word hashes, so each window costs a few operations. Equal
windows of a slice of texts are counted before the shuffle, which keeps a passage that very many documents share from
meeting in one task. The rest is sent packed (ids with counts, hashes) by hash bucket; Spark sorts each part by hash and id,
and one pass over the sorted rows tells the documents after the first of each hash, where the repeated windows merge into
maximal removal intervals.
A window is known by 64 bits and its bucket, which comes from a second polynomial.

Defined cases: a null text has no words; fewer words than a window are all kept; a null id is an ordinary id, below all
others; rows that repeat an id are one document, so windows that they share with each other stay; windows repeated
inside one document stay; an empty table gives an empty result; other columns aren't carried. Ids are whole numbers; any other
type that doesn't cast to long is refused by Spark. Long texts are read whole, one a slice. Of equal windows the least id keeps its own, and of
equal ids all do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, stored
from .words import list_array, mix, slices, split, word_hashes

WINDOW = 50
#: Bytes of text worked on at once: several workers share an executor's memory.
SLICE = 2_000_000
#: Odd bases of the two polynomials, modulo 2**64.
BASE, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
NULL_ID = -(2**63)
#: Id tables up to this many rows (at most 40 MB) may be broadcast.
NARROW_ROWS = 500_000
PACKED = "bucket int, ids array<long>, counts array<int>, hashes array<long>"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(values: np.ndarray, base: int, k: int) -> np.ndarray:
    """The polynomial of each k neighbours of values."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(values * powers(base, n))])
    back = powers(pow(base, -1, 2**64), n - k + 1)
    return mix((sums[k:] - sums[:-k]) * back)


def window_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, hash, second hash) of every window."""
    codes, distinct, starts = split(texts)
    words = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    one, two = rolling(words, BASE, k), rolling(mix(words), BASE_2, k)
    many = np.maximum(np.diff(starts) - k + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = starts[text] + place
    return text, place, one[at], two[at]


def packed(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """What documents (id, text) ask or know, by bucket: a bucket from 0 on holds one (id, hash) for each hash of a slice, with
    the slice's least id; negative ones hold the (id, hash) of which a smaller id is known already."""
    bits = buckets.bit_length() - 1

    def rows(bucket, ids, hashes):
        order = np.lexsort((ids, bucket))
        bucket, ids, hashes = bucket[order], ids[order], hashes[order]
        new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        new_id = new_bucket | np.concatenate([[True], ids[1:] != ids[:-1]])
        first = np.flatnonzero(new_id)
        sizes = np.diff(np.concatenate([first, [len(ids)]]))
        starts = np.flatnonzero(new_bucket)
        per = np.diff(np.concatenate([np.searchsorted(first, starts), [len(first)]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int32)), list_array(pa.array(ids[first]), per), list_array(pa.array(sizes.astype(np.int32)), per),
             list_array(pa.array(hashes.view(np.int64)), np.diff(np.concatenate([starts, [len(ids)]])))],
            ["bucket", "ids", "counts", "hashes"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            text, _, h, h2 = window_hashes(part.column(1), k)
            if not len(h):
                continue
            ids = part.column(0).to_numpy()[text]
            order = np.lexsort((ids, h))
            h, ids, h2 = h[order], ids[order], h2[order]
            fresh = np.concatenate([[True], h[1:] != h[:-1]])
            least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            other = ~fresh & (ids != np.concatenate([[0], ids[:-1]])) & (ids != least)
            yield rows((h2[fresh] >> np.uint64(64 - bits)).astype(np.int64), ids[fresh], h[fresh])
            if other.any():
                own = (mix(ids[other].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
                yield rows(-1 - own, ids[other], h[other])

    return docs.mapInArrow(work, PACKED)


def unpacked(sent: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, counts, hashes = (row.column(c).flatten() for c in (1, 2, 3))
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row.column(0)[0].as_py(), np.int32)), pa.array(np.repeat(ids.to_numpy(), counts.to_numpy())), hashes],
                    ["bucket", "id", "hash"],
                )

    return sent.mapInArrow(work, "bucket int, id long, hash long")


def repeated(docs: DataFrame, k: int) -> DataFrame:
    """(id, gone): the hashes of the document's windows that also start in a smaller id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(6, (2 * parts - 1).bit_length())
    rows = unpacked(packed(docs, k, buckets).repartition(parts, "bucket"))
    found = rows.sortWithinPartitions("hash", "bucket", "id").mapInArrow(later_ones, "id long, hash long")
    return found.groupBy("id").agg(F.collect_list("hash").alias("gone"))


def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, bucket and id, those of a larger id than their hash's least; all of negative buckets."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids, hashes = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(ids), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        least = ids.copy()
        if last is not None and (hashes[0], bucket[0]) == last[:2]:
            least[0] = last[2]
        least = least[np.flatnonzero(new)][np.cumsum(new) - 1]
        last = (hashes[-1], bucket[-1], least[-1])
        keep = pa.array((bucket < 0) | (ids > least))
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(keep), batch.column(2).filter(keep)], ["id", "hash"])


def removed(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, text, gone) with the words of repeated windows taken out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            touched = np.flatnonzero(part.column(2).is_valid().to_numpy(zero_copy_only=False))
            covers: dict[int, list[tuple[int, int]]] = {}
            if len(touched):
                some = part.take(pa.array(touched))
                text, place, h, _ = window_hashes(some.column(1), k)
                bounds = np.searchsorted(text, np.arange(len(touched) + 1))
                for t, i in enumerate(touched.tolist()):
                    a, b = bounds[t], bounds[t + 1]
                    gone = some.column(2)[t].values.to_numpy().view(np.uint64)
                    at = place[a:b][np.isin(h[a:b], gone)]
                    if len(at):
                        cut = np.flatnonzero(np.diff(at) > k) + 1
                        covers[i] = [(int(x[0]), int(x[-1]) + k) for x in np.split(at, cut)]
            total, less, kept, spans = [], [], [], []
            for i, value in enumerate(part.column(1)):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                own = covers.get(i, [])
                total.append(len(words))
                less.append(sum(b - a for a, b in own))
                for a, b in reversed(own):
                    del words[a:b]
                kept.append(b" ".join(words))
                spans.append([{"start": a, "end": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(less, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)],
                ["id", "n_words", "n_removed", "kept", "spans"],
            )

    return rows.select("id", "text", "gone").mapInArrow(work, "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans), a row for each row of docs. kept: what is left, joined by single spaces.
    spans: the removed words, from start to before end."""
    texts = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), named(text_col).alias("text"))
    found = stored(repeated(texts, window), "repeated")
    if found.count() <= NARROW_ROWS:
        ids = F.broadcast(found.select("id"))
        touched = texts.join(ids, "id", "left_semi").join(found, "id")
        plain = texts.join(ids, "id", "left_anti").withColumn("gone", F.lit(None).cast("array<long>"))
        rows = removed(touched, window).unionByName(removed(plain, window))
    else:
        rows = removed(texts.join(found, "id", "left"), window)
    return rows.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept", "spans")
