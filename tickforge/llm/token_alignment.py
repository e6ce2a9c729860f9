"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Tokens are known by where they end. While both sides advance one token at a time, their ends are equal at one shift of
index; exponential probing compares ever longer slices of the two arrays of ends at the current shift and so jumps over such
one-to-one runs. Where they differ, a merge of both sides finds the next common end, an irregular group, and gives the new shift.

A text is cut at spaces that follow a printed character: no token of either kind crosses there, so such a chunk is encoded by the
tokenizers' libraries and aligned once, and a worker keeps a bounded table of chunks. The byte-level vocabulary is applied by rank, which is
checked to be the same as by its merges. Each document's pairs
of linked ids are written with their counts; summed over the corpus, they are looked up again. Pairs of at least some count, at most PAIRS of
them, are broadcast; rarer ones are joined by shuffle.

Defined cases: texts that are null or empty, that hold the piece model's own space mark, or whose tokens don't give the text's bytes
back have no tokens; rows are independent but for the counts, so repeated ids, ties and null ids are ordinary rows that
count for themselves; a text of any length is aligned whole; of pairs that tie for an id's highest count all are best; other columns aren't
carried; an empty table gives an empty result. Ids may be of any type. Vocabularies of other kinds are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, token_counts
from .common import named, stored
from .words import release, slices

#: Pairs of ids that may be broadcast, 17 bytes each.
PAIRS = 2_000_000
#: Chunks and links of them that a worker keeps; the table starts anew when it is full.
KEPT, KEPT_LINKS = 400_000, 6_000_000
#: Bytes of text worked on at once, and chunks that are encoded as one text.
SLICE, JOINED = 2_000_000, 20


def ends_printed(chunk: str) -> bool:
    """Whether a space after the chunk would begin another."""
    return "!" <= chunk[-1] <= "~" or "À" <= chunk[-1] <= "ɏ"


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int]], list[int], list[int], list[int], list[int]]:
    """(runs, links a, links b, groups a, groups b): one-to-one runs as (place in a, place in b, length); the overlapping pairs of irregular
    groups by place; and the places where those groups begin. Both sides end alike."""
    n, i, j = len(ends_a), 0, 0
    runs, link_a, link_b, group_a, group_b = [], [], [], [], []
    while i < n:
        step, first, begun = 1, i, j
        while i < n and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        if i >= n:
            i, j = n, len(ends_b)
        while step > 1 and i < n:  # the slice that differs is halved until the first difference stands at i
            step //= 2
            if ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
        if i > first:
            runs.append((first, begun, min(i, n) - first))
        if i >= n:
            break
        group_a.append(i)
        group_b.append(j)
        link_a.append(i)
        link_b.append(j)
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
            link_a.append(i)
            link_b.append(j)
        i, j = i + 1, j + 1
    return runs, link_a, link_b, group_a, group_b


def joined(parts: pa.Array, counts: np.ndarray) -> Iterator[bytes]:
    """The parts of each text as one."""
    parts = pa.concat_arrays([parts, pa.array([""], parts.type)])
    ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
    data = memoryview(parts.buffers()[2] or b"")
    stops = ends[np.cumsum(counts)].tolist()
    for a, b in zip([0, *stops], stops, strict=False):
        yield data[a:b]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts, how many each has). A chunk begins at a space after an ASCII sign, digit or letter, or a letter of two bytes from C3 on, unless
    that space ends the text. Null and empty texts (a lone space) and those with the piece model's space mark have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    held = np.diff(ends) > 1
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
    held[np.searchsorted(ends, mark, side="right") - 1] = False
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    before, more = data[at - 1], data[np.maximum(at - 2, 0)]
    at = at[((before > 32) & (before < 127)) | ((before >= 128) & (more >= 0xC3) & (more <= 0xC9))]
    last = np.zeros(len(data) + 1, bool)
    last[ends[1:]] = True
    cut = np.zeros(len(data), bool)
    cut[at[~last[at + 1]]] = True
    cut[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(cut)
    counts = np.searchsorted(at, ends[1:]) - np.searchsorted(at, ends[:-1])
    parts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data.tobytes())])
    counts = np.where(np.diff(ends) > 0, counts, 0)
    if not held.all():
        parts = parts.filter(pa.array(np.repeat(held, counts)))
    return parts, np.where(held, counts, 0)


def as_ranks(spec: dict) -> dict[bytes, int]:
    """The tokens' bytes by id. Ids must stand in the order of the merges."""
    names, vocab = token_counts.byte_names(), spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(set(made)):
        raise ValueError("ids don't follow the order of the merges")
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(names[c] for c in w): i for w, i in vocab.items() if w not in added}


def refuse_unreachable(vocabulary: bytes) -> None:
    """Raises unless each token's own bytes merge into it: then merges by the rank of the joined bytes, whatever the two parts are, are the
    listed merges."""
    from tokenizers import Tokenizer

    spec = json.loads(vocabulary)
    token_counts.refuse_others(spec)
    as_ranks(spec)
    model, added = Tokenizer.from_str(vocabulary.decode()).model, {t["content"] for t in spec["added_tokens"]}
    if any([t.id for t in model.tokenize(w)] != [i] for w, i in spec["model"]["vocab"].items() if w not in added):
        raise ValueError("a token can't be reached by the merges")


class Aligner:
    """Chunks as places of a table: their ids on both sides, links and groups."""

    def __init__(self, byte_level: bytes, proto: bytes):
        import sentencepiece
        import tiktoken

        ranks = as_ranks(json.loads(byte_level))
        self.a = tiktoken.Encoding("a", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size, self.n_a = self.b.get_piece_size(), max(ranks.values()) + 1
        self.raw_a = [b""] * self.n_a
        for raw, i in ranks.items():
            self.raw_a[i] = raw
        self.raw_b = pieces.Model(proto).raw.to_pylist()
        self.long_a, self.long_b = (np.array([len(x) for x in raw]) for raw in (self.raw_a, self.raw_b))
        # Every id followed by each of its separators, as told in a document's groups.
        self.told = pa.array([f"{i}{s}" for n, both in ((self.n_a, ",|"), (self.size, ",;")) for s in both for i in range(n)])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.facts = np.empty((0, 4), np.int64)  # tokens of a, of b, groups, links; none where the bytes differ
        self.links = np.empty(0, np.int64)  # a's id times the number of pieces, and b's id
        self.ok = np.empty(0, bool)
        self.text = pa.array([], pa.large_string())

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks on both sides, one after another."""
        inner = sum(map(ends_printed, chunks))  # those of texts' ends, which come last, may touch what follows
        alone = chunks[inner:]
        left = [self.a.encode_ordinary("".join(chunks[:inner])), *map(self.a.encode_ordinary, alone)]
        right = self.b.encode([c[1:] for c in ("".join(chunks[i : min(i + JOINED, inner)]) for i in range(0, inner, JOINED))] + [c[1:] for c in alone], num_threads=1)
        return tuple(np.array([i for x in side for i in x], np.int64) for side in (left, right))

    def holds(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(b"".join(map(raw.__getitem__, ids.tolist())) == data for raw, ids in ((self.raw_a, a), (self.raw_b, b)))

    def learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        chunks = sorted(chunks, key=ends_printed, reverse=True)
        same, good = np.ones(len(chunks), bool), chunks
        flat_a, flat_b = self.encoded(chunks)
        if not self.holds("".join(chunks).encode(), flat_a, flat_b):
            same = np.array([self.holds(c.encode(), *self.encoded([c])) for c in chunks])
            good = [c for c, s in zip(chunks, same.tolist(), strict=True) if s]
            flat_a, flat_b = self.encoded(good) if good else (flat_a[:0], flat_b[:0])
        sizes = np.zeros(len(chunks), np.int64)
        sizes[same] = pc.binary_length(pa.array(good, pa.string())).to_numpy(zero_copy_only=False)
        stops, (ends_a, ends_b) = np.cumsum(sizes), (np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b]))
        runs, link_a, link_b, group_a, group_b = align(ends_a.tolist(), ends_b.tolist())
        run_a, run_b, run_n = np.array(runs, np.int64).reshape(-1, 3).T
        one_a, one_b = spread(run_a, run_n), spread(run_b, run_n)
        start_a = np.sort(np.concatenate([one_a, np.array(group_a, np.int64)]))
        start_b = np.sort(np.concatenate([one_b, np.array(group_b, np.int64)]))
        at_a, at_b = np.concatenate([one_a, np.array(link_a, np.int64)]), np.concatenate([one_b, np.array(link_b, np.int64)])
        by = np.argsort(at_a, kind="stable")
        at_a, at_b = at_a[by], at_b[by]
        bounds = lambda ends: np.searchsorted(ends, stops, side="right")  # noqa: E731  tokens up to a chunk's end
        upto_a, upto_b = bounds(ends_a), bounds(ends_b)
        upto = [upto_a, upto_b, np.searchsorted(start_a, upto_a), np.searchsorted(at_a, upto_a)]
        facts = np.stack([np.diff(x, prepend=0) for x in upto], 1)
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.facts, self.links = np.concatenate([self.facts, facts]), np.concatenate([self.links, flat_a[at_a] * self.size + flat_b[at_b]])
        self.ok = np.concatenate([self.ok, same])
        self.text = pa.concat_arrays([self.text, self.as_text(flat_a, flat_b, start_a, start_b, facts[:, 0] + facts[:, 1])])

    def as_text(self, flat_a: np.ndarray, flat_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The groups of every chunk, each closed by a semicolon."""
        n_a, n_b = len(flat_a), len(flat_b)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        order = np.empty(n_a + n_b, np.int64)
        if len(order):
            last_a[np.append(start_a[1:], n_a) - 1] = 1
            last_b[np.append(start_b[1:], n_b) - 1] = 1
            of_a = np.searchsorted(start_a, np.arange(n_a), side="right") - 1
            of_b = np.searchsorted(start_b, np.arange(n_b), side="right") - 1
            order[np.arange(n_a) + start_b[of_a]] = flat_a + last_a * self.n_a
            order[np.arange(n_b) + np.append(start_a[1:], n_a)[of_b]] = flat_b + last_b * self.size + 2 * self.n_a
        return pc.binary_join(pieces.list_array(self.told.take(pa.array(order)), sizes), "").cast(pa.large_string())

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of all chunks, how many each text has). A text without tokens has none. Texts begin with the space put before them."""
        if len(self.index) > KEPT or len(self.links) > KEPT_LINKS:
            self.clear()
        chunks, counts = chunks_of(texts)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([c for c in distinct if c not in self.index])
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(counts)), counts)
        wrong = np.bincount(doc, weights=~self.ok[at], minlength=len(counts)) > 0
        return at[~wrong[doc]], np.where(wrong, 0, counts)


_loaded: dict[str, Aligner] = {}


def _aligner(key: str, shared) -> Aligner:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*shared.value)
    return _loaded[key]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def aligned(rows: DataFrame, key: str, shared) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of rows (doc_id, text): every pair of linked ids, and how many links hold
    it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key, shared)
        for part in slices(batches, 1, SLICE):
            places, counts = aligner.places(part.column(1))
            doc = np.repeat(np.arange(len(counts)), counts)
            facts = [np.bincount(doc, weights=f, minlength=len(counts)).astype(np.int64) for f in aligner.facts[places].T]
            text = joined(aligner.text.take(pa.array(places)), counts)
            digest = [hashlib.sha256(t[:-1]).hexdigest() if len(t) else "" for t in text]
            # A document holds a chunk several times, and a pair in several chunks.
            at, times = summed(doc * len(aligner.facts) + places, np.ones(len(doc), np.int64))
            own, at = np.divmod(at, max(1, len(aligner.facts)))
            many = aligner.facts[at, 3]
            pair = aligner.links[spread((np.cumsum(aligner.facts[:, 3]) - aligner.facts[:, 3])[at], many)]
            wide = aligner.size * aligner.n_a
            keys, times = summed(np.repeat(own, many) * wide + pair, np.repeat(times, many))
            own, pair = np.divmod(keys, wide)
            size = np.bincount(own, minlength=len(counts))
            made = [*map(pa.array, facts), pa.array(digest, pa.string()), pieces.list_array(pa.array(pair), size), pieces.list_array(pa.array(times), size)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names)
            release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(work, schema)


def pair_counts(made: DataFrame, size: int, most: int) -> DataFrame:
    """(pair, links, best): the links of every pair of ids in the corpus, and whether no pair with the same second id has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            own = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2)]
            total = summed(*(np.concatenate(x) for x in zip(total, own, strict=True)))
            if len(total[0]) > most:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["pair", "links"])
                total = total[0][:0], total[1][:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["pair", "links"])
        release()

    counted = made.select("pairs", "times").mapInArrow(work, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counted, piece = stored(counted, "pair-counts"), F.pmod("pair", F.lit(size))
    # A row for each piece of the second vocabulary: a bounded table.
    top = counted.groupBy(piece.alias("piece")).agg(F.max("links").alias("most"))
    return counted.withColumn("piece", piece).join(F.broadcast(top), "piece").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, most: int) -> int:
    """The least count of links that at most `most` pairs have; 0 if these are all."""
    total, least = pairs.count(), 0
    while total > most:
        least = max(2 * least, pairs.where(F.col("links") >= least).agg(F.percentile_approx("links", 1 - most / total / 2)).first()[0] + 1)
        total = pairs.where(F.col("links") >= least).count()
    return least


def align_tokens(docs: DataFrame, byte_level_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). pairs: how many pairs of ids may be broadcast."""
    vocabulary, proto = Path(byte_level_path).read_bytes(), Path(model_path).read_bytes()
    refuse_unreachable(vocabulary)
    pieces.refuse_others(proto)
    spark, key = docs.sparkSession, hashlib.sha256(vocabulary + proto).hexdigest()
    shared = spark.sparkContext.broadcast((vocabulary, proto))
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    rows = docs.select(named(id_col).alias("doc_id"), F.concat(F.lit(" "), named(text_col).cast("string")).alias("text"))
    made = stored(aligned(rows, key, shared), "aligned")
    told = stored(pair_counts(made, size, pairs), "pairs")
    least = frequent(told, pairs)
    kept = told.where(F.col("links") >= least).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(kept[c].to_numpy() for c in ("pair", "links", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = table.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            own, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = []
            for fact in (best, links):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, doc[hit], times[hit] * fact[at[hit]].astype(np.int64))
                sums.append(pa.array(total))
            rare = np.bincount(doc[~hit], minlength=len(sizes))
            lists = [pieces.list_array(pa.array(x[~hit]), rare) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *lists], ["own", "n_best", "count_sum", "pairs", "times"])
            release()

    facts = F.struct("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").alias("own")
    packed = made.select(facts, "pairs", "times")
    kind = packed.schema["own"].dataType.simpleString()
    found = packed.mapInArrow(look_up, f"own {kind}, n_best long, count_sum long, pairs array<bigint>, times array<bigint>")
    if least:
        found = stored(found.withColumn("row", F.monotonically_increasing_id()), "looked-up")
        rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        more = rare.join(told.where(F.col("links") < least), "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("links")).alias("more_sum")
        )
        found = found.join(more, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        )
    return found.select(*[F.col("own").getField(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], "n_best", "count_sum", F.col("own.groups_sha256").alias("groups_sha256"))
