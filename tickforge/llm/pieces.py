"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

The distinct units (words with the spaces before them) of a batch are concatenated and indexed by a suffix array. Every piece
of the vocabulary is searched in it by bisection, which gives its occurrences: edges over the text. The edges are sorted by
position (a counting sort: a row for each position) and relaxed: in every unit the best-scored edge that spans two neighbouring
symbols joins them, until none does; short units go through this side by side, long ones by a heap. That is
the model's own rule; a shortest path over the same edges would give other pieces than a BPE model does. Units and ids come back
to whole documents by array gathers.

A unit longer than INDEXED is indexed in overlapping parts, and only its edges are kept, sorted by position and length.

Defined cases: a null or empty text has no pieces and decodes to the empty text; characters without a piece become byte pieces;
rows are independent, so repeated ids and ties change nothing; other columns pass through, and one named like an added column is
replaced; an empty table gives an empty result; the model's own space mark in a text reads as a space, so such a text decodes
otherwise than it was (round_trip is false); ids out of range are refused, and so are models of another kind than BPE, with a
normaliser, without the space mark before the text, or with user-defined symbols. Document ids may be of any type.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from .common import carry, named, others, unpacked
from .words import list_array, release, slices

MARK = "▁"
#: Distinct units that a worker keeps, with at most 12 characters each on average; the table starts anew when it is full.
KEPT = 200_000
#: Bytes of text worked on at once, characters indexed at once, and the longest unit that is relaxed beside others.
SLICE, INDEXED, SHORT = 1_000_000, 200_000, 200
#: Documents decoded at once.
DECODED = 500
BREAK = 0x110000


def coded(text: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, more, bits): both with the symbols of text numbered from 1 in their order, others as 0, and the bits that a number takes."""
    seen = np.zeros(int(max(text.max(initial=0), more.max(initial=0))) + 1, bool)
    seen[text] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    return place[text], np.where(more < 0, 0, place[more]), len(alphabet).bit_length()


def heads(codes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k symbols from each place on as one number; 0 beyond the end."""
    padded, key = np.concatenate([codes, np.zeros(k, np.int64)]), np.zeros(len(codes), np.int64)
    for j in range(k):
        key = key << bits | padded[j : j + len(codes)]
    return key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text in the order of their first `depth` symbols, at least; by doubling, from as many as a number holds."""
    codes, _, bits = coded(text, np.empty(0, np.int64))
    n, done = len(text), min(depth, 62 // bits)
    key = heads(codes, bits, done)
    while True:
        order = np.argsort(key)
        if done >= depth:
            return order
        by = key[order]
        new = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = rank[done:] + 1
        key = rank * (n + 1) + after
        done *= 2


def occurrences(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each piece in the suffix array, by bisection of as many symbols at once as a number holds. pieces: one row each, -1 after
    its end."""
    codes, wanted, bits = coded(text, pieces)
    k = min(pieces.shape[1], 62 // bits)
    held = heads(codes, bits, k)
    low, high = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)

    def bound(a: np.ndarray, b: np.ndarray, want: np.ndarray, d: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) // 2
            at = order[mid] + d
            have = np.where(at < len(text), held[np.minimum(at, len(text) - 1)], 0)
            less = have < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]

    live = np.flatnonzero(((wanted > 0) | (np.arange(pieces.shape[1]) >= lengths[:, None])).all(axis=1))
    for d in range(0, pieces.shape[1], k):
        part = wanted[live, d : d + k]
        size = np.minimum(lengths[live] - d, k)
        open_bits = bits * (k - size)
        least = heads_of(part, bits, k) >> open_bits << open_bits
        most = least + (np.int64(1) << open_bits)
        if d:
            first = bound(low[live], high[live], least, d)
            low[live], high[live] = first, bound(first, high[live], most, d)
        else:
            by = held[order]
            low[live], high[live] = np.searchsorted(by, least), np.searchsorted(by, most)
        live = live[(lengths[live] > d + k) & (low[live] < high[live])]
        if not len(live):
            break
    return low, high


def heads_of(rows: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The first k symbols of each row as one number; 0 beyond its end."""
    key = np.zeros(len(rows), np.int64)
    for j in range(k):
        key = key << bits | (rows[:, j] if j < rows.shape[1] else 0)
    return key


def relax(n: int, rank: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Spans of the symbols that are left of n characters. rank(start, stop): place of the edge's score, best first; -1 if
    there is none. A pair waits as one number, its rank before its place."""
    end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [r << 40 | i for i in range(n - 1) if (r := rank(i, i + 2)) >= 0]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & (1 << 40) - 1
        j = end[i]
        if j <= 0 or j >= n or rank(i, end[j]) != top >> 40:
            continue  # one of the two has changed since
        stop = end[i] = end[j]
        end[j] = 0
        if stop < n:
            before[stop] = i
            if (r := rank(i, end[stop])) >= 0:
                heapq.heappush(heap, r << 40 | i)
        h = before[i]
        if h >= 0 and (r := rank(h, stop)) >= 0:
            heapq.heappush(heap, r << 40 | h)
    return [(i, end[i]) for i in range(n) if end[i]]


def relax_together(starts: np.ndarray, sizes: np.ndarray, cost: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of what is left of all units, each of which joins its best neighbours, the left ones among equals, once a round."""
    unit = np.repeat(np.arange(len(starts)), sizes)
    first = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[unit]
    stop = first + 1
    none = np.full(len(unit), np.inf)
    pair = none.copy()
    inner = unit[1:] == unit[:-1]
    pair[:-1][inner] = cost(first[:-1][inner], stop[1:][inner])
    done = []
    while len(unit):
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        counts = np.diff(np.concatenate([heads, [len(unit)]]))
        least = np.repeat(np.minimum.reduceat(pair, heads), counts)
        over = np.isinf(least)
        if over.any():
            done.append((first[over], stop[over]))
            unit, first, stop, pair, least = (x[~over] for x in (unit, first, stop, pair, least))
            if not len(unit):
                break
        at = np.flatnonzero(pair == least)
        at = at[np.concatenate([[True], unit[at][1:] != unit[at][:-1]])]
        stop[at] = stop[at + 1]
        keep = np.ones(len(unit), bool)
        keep[at + 1] = False
        at = np.cumsum(keep)[at] - 1
        unit, first, stop, pair = (x[keep] for x in (unit, first, stop, pair))
        for i in (at, at[at > 0] - 1):
            linked = np.flatnonzero((i + 1 < len(unit)) & (unit[i] == unit[np.minimum(i + 1, len(unit) - 1)]))
            pair[i] = np.inf
            pair[i[linked]] = cost(first[i[linked]], stop[i[linked] + 1])
    if not done:
        return first, stop
    first, stop = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(first)
    return first[order], stop[order]


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if size is None else size
        yield tag >> 3, message[at : at + size]
        at += size


def refuse_others(proto: bytes) -> None:
    """Raises unless the model is one that these operators encode as the library does."""
    # Field numbers of the published model format.
    piece, trainer, normaliser = 1, 2, 3
    piece_type, user_defined, model_type, bpe, suffix_space = 3, 4, 3, 2, 24
    rules, prefix, trim, escape = 2, 3, 4, 5
    parts = list(fields(proto))
    made = {k: v for f, m in parts if f == trainer for k, v in fields(m)}
    norm = {k: v for f, m in parts if f == normaliser for k, v in fields(m)}
    if made.get(model_type, 1) != bpe or made.get(suffix_space, 0):
        raise ValueError("not a BPE model with the space mark before words")
    if norm.get(rules) or not norm.get(prefix, 1) or norm.get(trim, 1) or not norm.get(escape, 1):
        raise ValueError("the model normalises its text")
    if any(dict(fields(m)).get(piece_type, 1) == user_defined for f, m in parts if f == piece):
        raise ValueError("the model has user-defined symbols")


class Model:
    """A BPE model's pieces, scores and byte pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        refuse_others(proto)
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        plain.sort(key=names.__getitem__)  # neighbours are searched together
        self.scores = [sp.get_score(i) for i in range(self.size)]
        self.single = {names[i]: i for i in plain if len(names[i]) == 1}
        self.bytes = {int(names[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ids = np.array([i for i in plain if len(names[i]) > 1])
        self.lengths = np.array([len(names[i]) for i in self.ids])
        self.pieces = np.full((len(self.ids), self.lengths.max()), -1, np.int64)
        for row, i in enumerate(self.ids):
            self.pieces[row, : len(names[i])] = list(map(ord, names[i]))
        # Where no piece crosses from a word to a space, nor holds a line end, units can't touch each other.
        self.whole = any(MARK in names[i].lstrip(MARK) for i in self.ids)
        self.line = not any("\n" in names[i] for i in self.ids)
        raw = [b"" if sp.is_control(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        if self.unknown >= 0:
            raw[self.unknown] = " ⁇ ".encode()
        self.raw = pa.array(raw, pa.binary())
        self.one = np.full(0x110000, -1, np.int32)
        for c, i in self.single.items():
            self.one[ord(c)] = i
        self.cost = -np.array(self.scores)
        self.rank = np.unique(self.cost, return_inverse=True)[1].tolist()
        self.wide = int(self.lengths.max())
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.sizes, self.chars = np.empty(0, np.int32), np.empty(0, np.int64), 0

    def leaf(self, code: int) -> list[int]:
        return [self.bytes[b] for b in chr(code).encode()] if self.bytes else [self.unknown]

    def match(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has)."""
        sizes = np.array([len(u) for u in units])
        joined = np.frombuffer("\0".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        joined[(starts + sizes)[:-1]] = BREAK
        order = suffix_array(joined, self.wide)
        low, high = occurrences(joined, order, self.pieces, self.lengths)
        edges = np.full((len(joined), self.wide + 1), -1, np.int32)
        found = np.flatnonzero(high > low)
        many = high[found] - low[found]
        at = order[np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        edges[at, np.repeat(self.lengths[found], many)] = np.repeat(self.ids[found], many)

        def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            size = b - a
            e = edges[a, np.minimum(size, self.wide)]
            return np.where((size <= self.wide) & (e >= 0), self.cost[e], np.inf)

        brief = sizes <= SHORT
        first, stop = relax_together(starts[brief], sizes[brief], cost)
        spans = [(first, stop)]
        for u in np.flatnonzero(~brief):
            s = int(starts[u])

            def own(a: int, b: int, s: int = s) -> int:
                e = edges[s + a, b - a] if b - a <= self.wide else -1
                return self.rank[e] if e >= 0 else -1

            left = np.array(relax(int(sizes[u]), own)) + s
            spans.append((left[:, 0], left[:, 1]))
        first, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        by = np.argsort(first)
        first, stop = first[by], stop[by]
        ids = np.where(stop - first > 1, edges[first, np.minimum(stop - first, self.wide)], self.one[joined[first]])
        unit = np.searchsorted(starts, first, side="right") - 1
        ids, unit = self.with_leaves(ids, unit, joined[first])
        return ids, np.bincount(unit, minlength=len(units))

    def with_leaves(self, ids: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their units, with the byte pieces of characters that have no piece."""
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            leaves = [self.leaf(int(c)) for c in codes[bare]]
            grown = np.ones(len(ids), np.int64)
            grown[bare] = [len(x) for x in leaves]
            place = np.cumsum(grown) - grown
            wide = np.repeat(ids, grown)
            for p, x in zip(place[bare].tolist(), leaves, strict=True):
                wide[p : p + len(x)] = x
            ids, unit = wide, np.repeat(unit, grown)
        return ids.astype(np.int32), unit

    def match_long(self, unit: str) -> np.ndarray:
        """The ids of one long unit, indexed in parts that overlap by less than a piece."""
        codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        step, keys, found = self.wide + 1, [], []
        for start in range(0, len(codes), INDEXED):
            part = codes[start : start + INDEXED + self.wide - 1].astype(np.int64)
            order = suffix_array(part, self.wide)
            low, high = occurrences(part, order, self.pieces, self.lengths)
            hit = np.flatnonzero(high > low)
            many = high[hit] - low[hit]
            at = order[np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            key, own = (start + at) * step + np.repeat(self.lengths[hit], many), np.repeat(self.ids[hit], many).astype(np.int32)
            own, key = own[at < INDEXED], key[at < INDEXED]
            by = np.argsort(key)
            keys.append(key[by])
            found.append(own[by])
        edges, ids = array("q", np.concatenate(keys).tobytes()), np.concatenate(found)

        def edge(a: int, b: int) -> int:
            if b - a > self.wide:
                return -1
            key = a * step + b - a
            at = bisect_left(edges, key)
            return int(ids[at]) if at < len(edges) and edges[at] == key else -1

        left = np.array(relax(len(codes), lambda a, b: self.rank[e] if (e := edge(a, b)) >= 0 else -1))
        out = np.array([edge(a, b) if b - a > 1 else self.one[codes[a]] for a, b in left.tolist()])
        return self.with_leaves(out, np.zeros(len(out), np.int64), codes[left[:, 0]])[0]

    def learn(self, units: list[str]) -> None:
        a = 0
        while a < len(units):
            b, chars = a, 0
            while b < len(units) and (b == a or chars + len(units[b]) <= INDEXED):
                chars += len(units[b])
                b += 1
            if chars > INDEXED:
                ids = self.match_long(units[a])
                sizes = np.array([len(ids)])
            else:
                ids, sizes = self.match(units[a:b])
            self.index.update(zip(units[a:b], range(len(self.index), len(self.index) + b - a), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
            self.chars += chars
            a = b

    def units(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """(units of all texts, how many each has): spaces and what follows up to the next space; a line end by itself. The mark is a space here."""
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), MARK, " ")
        led = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(" ", spaced, ""))
        _, offsets, data = led.buffers()
        ends = np.frombuffer(offsets, np.int32)[led.offset : led.offset + len(led) + 1] if len(led) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return pa.array([], pa.string()), np.zeros(len(led), np.int64)
        held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        opens = np.zeros(len(held), bool)
        opens[ends[:-1][np.diff(ends) > 0] - ends[0]] = True
        if not self.whole:
            blank = held == ord(" ")
            opens[1:] |= blank[1:] & ~blank[:-1]
        if not self.whole and self.line:
            line = held == ord("\n")
            opens |= line
            opens[1:] |= line[:-1]
        starts = np.flatnonzero(opens) + ends[0]
        places = pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32))
        return pa.StringArray.from_buffers(len(starts), places, data), np.diff(np.searchsorted(starts, ends))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        units, counts = self.units(texts)
        coded_units = units.dictionary_encode()
        distinct = pc.replace_substring(coded_units.dictionary, " ", MARK).to_pylist()
        self.learn([u for u in distinct if u not in self.index])
        places = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded_units.indices.to_numpy(zero_copy_only=False)]
        own = self.sizes[places]
        ends = np.cumsum(own)
        ids = self.flat[np.repeat((np.cumsum(self.sizes) - self.sizes)[places] - (ends - own), own) + np.arange(own.sum())]
        marks = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if len(self.index) > KEPT or self.chars > 12 * KEPT:
            self.clear()
        return list_array(pa.array(ids, pa.int32()), np.diff(marks))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten()
        if len(flat) and (pc.max(flat).as_py() >= self.size or pc.min(flat).as_py() < 0):
            raise ValueError("an id is out of the model's range")
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        joined = pc.binary_join(list_array(self.raw.take(flat), counts), b"")
        return pa.array([(b[1:] if b[:1] == b" " else b).decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


_loaded: dict[str, Model] = {}


def _model(key: str, shared) -> Model:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(shared.value)
    return _loaded[key]


def shared_model(spark, model_path: str) -> tuple:
    """A digest of the model and its bytes (under a MB whatever the data), read on the driver and broadcast."""
    proto = Path(model_path).read_bytes()
    refuse_others(proto)
    return hashlib.sha256(proto).hexdigest(), spark.sparkContext.broadcast(proto)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """docs with `ids_col`, the piece ids of the whole text, and `check_col`, if one is named: whether the ids decode to the text."""
    key, shared = shared_model(docs.sparkSession, model_path)
    added = [c for c in (ids_col, check_col) if c]
    names = others(docs, *added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared)
        for part in slices(batches, 1, SLICE):
            made = [model.encode(part.column(1))]
            if check_col:
                made.append(pc.equal(decoded(model, made[0]), pc.fill_null(part.column(1), "")))
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["own", *added])

    rows = docs.select(carry(docs, names), named(text_col).alias("text"))
    schema = rows.select("own").schema.add(ids_col, ArrayType(IntegerType()))
    schema = schema.add(check_col, BooleanType()) if check_col else schema
    return rows.mapInArrow(work, schema).select(*unpacked(names), *[named(c) for c in added])


def decoded(model: Model, ids: pa.ListArray) -> pa.Array:
    parts = [model.decode(ids.slice(a, DECODED)) for a in range(0, len(ids), DECODED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def decode_pieces(spark, model_path: str):
    """A column function from piece ids to text."""
    key, shared = shared_model(spark, model_path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        made = decoded(_model(key, shared), ids)
        release()
        return made

    return decode


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): round_trip says whether the ids decode to the text."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    made = encode_pieces(rows, model_path, check_col="round_trip")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
