"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

Documents of equal sets are one node. Shingles are put in one order for all, rare ones first, by a counted table of hash
buckets; a set's first shingles are its prefix. Nodes meet in the lists of the prefix shingles that they share; of two that meet, the
smaller set must have the shingle in its shorter prefix, which is enough where the other set is no smaller. Pairs pass length and
positional filters, then a suffix filter on parity sketches (a bit for each hash range tells whether it holds an odd number of
shingles, so the bits that differ bound the shingles not shared), and are verified once on the whole sets. To keep groups of near
copies linear, each list's nodes first meet only its first node; what these links join is one label, and only nodes of different
labels meet after that, by length band and, in long lists, in blocks of nodes. No link between labels is lost, so the
components are those of all links.

Defined cases: a null text or one without words has no shingles and links with nothing; fewer words than a shingle are one
shingle; a null id is an ordinary id, below all others; rows that repeat an id are one document: each of its sets is a node, and
these are tied (by_row: they are not); an empty table gives an empty result; other columns aren't carried. Ids are whole
numbers; any other type that doesn't cast to long is refused by Spark. Long texts give all their shingles; shingles of equal frequency go by their hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, stored
from .components import components
from .words import list_array, mix, shingles, slices, split

#: Hash buckets of the table of shingle frequencies: 16 MB for each task, whatever the data.
FREQUENCY_BITS, CHUNK_BITS = 22, 14
#: Tasks whose counts are added up together first.
COMBINED = 256
#: Longs of a set's parity sketch.
SKETCH = 8
#: Id tables up to this many rows (at most 40 MB) may be broadcast.
NARROW_ROWS = 500_000
#: A shingle whose bucket counts at most so many documents has a list that one task may sort; longer lists are counted
#: before the shuffle. Of those, lists with more than HOT_SHARE of the entries, so at most its inverse, join by broadcast.
SHORT_LIST, HOT_SHARE = 20_000, 1e-5
#: Nodes of a list that meet each other at once, on either side.
BLOCK = 256
NULL_ID = -(2**63)


def narrow(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= NARROW_ROWS else table


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col)
    return docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("own"))


def quotient(a: Column, b: int) -> Column:
    """a / b, rounded up, in whole numbers."""
    return ((a + F.pmod(-a, F.lit(b))) / b).cast("long")


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Documents by shingle bucket, over all documents: tasks count, Spark sums (in two steps beyond COMBINED tasks), the driver gets the
    fixed-size table."""
    size, chunk = 1 << FREQUENCY_BITS, 1 << CHUNK_BITS
    crowd = COMBINED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for part in slices(batches, 1):
            _, h = shingles(*split(part.column(1), lower=True), k)
            bucket, many = np.unique(h >> np.uint64(64 - FREQUENCY_BITS), return_counts=True)
            total[bucket.astype(np.int64)] += many.astype(np.uint32)
        rows = total.reshape(-1, chunk)
        used = np.flatnonzero(rows.any(axis=1))
        group = TaskContext.get().partitionId() // crowd
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([group] * len(used), pa.int64()), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in used], pa.binary())],
            ["chunk", "part", "counts"],
        )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.int64)
        for batch in batches:
            for value in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(value.as_py()), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    parts = docs.mapInArrow(count, "chunk long, part long, counts binary")
    if docs.rdd.getNumPartitions() > crowd:
        parts = parts.groupBy("chunk", "part").applyInArrow(add, "chunk long, counts binary")
    parts = parts.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    out = np.zeros(size, np.uint32)
    for r in parts:
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


def ceil_of(share: Fraction, n: np.ndarray) -> np.ndarray:
    return -(-n * share.numerator // share.denominator)


def prefixes(docs: DataFrame, k: int, limit: Fraction, table: np.ndarray) -> DataFrame:
    """(doc, own, n, f1, f2, sketch, prefix, n_short): hash of the text, set size, fingerprint of the set, parity by hash range, the rarest
    n - ceil(limit * n) + 1 shingles in order, and how many of these, the first, have short lists."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for part in slices(batches, 1):
            text, h = shingles(*split(part.column(1), lower=True), k)
            rows = part.num_rows
            n = np.bincount(text, minlength=rows).astype(np.int64)
            ends = np.cumsum(n)
            sums = []
            for seed in (1, 2):
                with_zero = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(np.array([seed], np.uint64))), dtype=np.uint64)])
                sums.append((with_zero[ends] - with_zero[ends - n]).view(np.int64))
            bit = (mix(h) >> np.uint64(55)).astype(np.int64)
            odd = np.bincount(text * 64 * SKETCH + bit, minlength=rows * 64 * SKETCH).astype(np.uint8) & 1
            sketch = np.packbits(odd).view(np.int64)
            often = rare[(h >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
            order = np.lexsort((h, often, text))
            place = np.arange(len(h)) - np.repeat(ends - n, n)
            length = np.where(n > 0, n - ceil_of(limit, n) + 1, 0)
            head = place < np.repeat(length, n)
            first = h[order][head].view(np.int64)
            brief = np.bincount(text[order][head & (often[order] <= SHORT_LIST)], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]),
                 list_array(pa.array(sketch), np.full(rows, SKETCH)), list_array(pa.array(first), length), pa.array(brief.astype(np.int32))],
                ["doc", "own", "n", "f1", "f2", "sketch", "prefix", "n_short"],
            )

    return docs.mapInArrow(cut, "doc long, own long, n int, f1 long, f2 long, sketch array<long>, prefix array<long>, n_short int")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles) in the order of the hashes, for docs (id, text, f1, f2): rows whose set has that fingerprint. Node ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            text, h = shingles(*split(part.column(1), lower=True), k)
            n = np.bincount(text, minlength=part.num_rows).astype(np.int64)
            ends = np.cumsum(n)
            fits = np.ones(part.num_rows, bool)
            for seed, column in ((1, 2), (2, 3)):
                with_zero = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(np.array([seed], np.uint64))), dtype=np.uint64)])
                fits &= (with_zero[ends] - with_zero[ends - n]).view(np.int64) == part.column(column).to_numpy()
            sets = list_array(pa.array(h.view(np.int64)), n)
            mask = pa.array(fits)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), sets.filter(mask)], ["id", "shingles"])

    return docs.select("id", "text", "f1", "f2").mapInArrow(make, "id long, shingles array<long>")


def needed(limit: Fraction, a: Column, b: Column) -> Column:
    """The least overlap of sets of sizes a and b that are alike enough."""
    return quotient((a.cast("long") + b.cast("long")) * limit.numerator, limit.numerator + limit.denominator)


def shorter_prefix(limit: Fraction, n: Column) -> Column:
    """How many of a set's first shingles hold one of every set alike that is no smaller."""
    return n - quotient(n.cast("long") * 2 * limit.numerator, limit.numerator + limit.denominator) + 1


def band(limit: Fraction, n: Column) -> Column:
    """Sizes of alike sets lie in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / (-math.log(limit) * 1.000001)).cast("int") if limit < 1 else n.cast("int")


def length_and_place(limit: Fraction, n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    p, q = limit.numerator, limit.denominator
    alike = (F.least(n, n2).cast("long") * q >= F.greatest(n, n2).cast("long") * p)
    # At the first shared shingle, what is left of either set bounds the overlap.
    return alike & (F.least(n - pos, n2 - pos2) >= needed(limit, n, n2))


def sketches_allow(limit: Fraction, n: Column, sketch: Column, n2: Column, sketch2: Column) -> Column:
    """Whether no more sketch bits differ than sets that are alike may have shingles not shared."""
    differ = None
    for i in range(SKETCH):
        bits = F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(sketch2, F.lit(i))))
        differ = bits if differ is None else differ + bits
    return differ <= n.cast("long") + n2.cast("long") - 2 * needed(limit, n, n2)


def verified(pairs: DataFrame, info: DataFrame, texts: DataFrame, k: int, limit: Fraction) -> DataFrame:
    """(u, v) of the pairs (a, b) that are alike. Each pair comes once. The suffix filter goes first: sets are made again only
    for the documents of the pairs that it leaves."""
    side = lambda name: info.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"k_{name}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("need", needed(limit, F.col("n_a"), F.col("n_b")))
    held = held.where(sketches_allow(limit, F.col("n_a"), F.col("k_a"), F.col("n_b"), F.col("k_b")))
    held = stored(held.select("a", "b", "need").distinct(), "pairs")
    users = held.select(F.col("a").alias("id")).unionByName(held.select(F.col("b").alias("id"))).distinct()
    users = narrow(stored(users.join(info.select("id", "doc", "f1", "f2"), "id"), "users"))
    sets = stored(whole_sets(texts.join(users, "doc"), k), "sets")
    one = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"s_{name}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = batch.column(2).to_numpy()
            left, right = batch.column(3), batch.column(4)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy().view(np.uint64), right[i].values.to_numpy().view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep[i] = int((y[at] == x).sum()) >= need[i]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return held.join(one("a"), "a").join(one("b"), "b").select("a", "b", "need", "s_a", "s_b").mapInArrow(check, "u long, v long")


def entries_of(rows: DataFrame) -> DataFrame:
    """(token, id, n, pos): prefix entries. Those of short lists have a neighbour in the list: one shuffle finds them."""
    entry = F.posexplode("prefix").alias("pos", "token")
    brief = rows.where("n_short > 0").select("id", "n", F.posexplode(F.slice("prefix", 1, F.col("n_short"))).alias("pos", "token"))
    w = Window.partitionBy("token").orderBy("id")
    brief = brief.withColumn("before", F.lag("id").over(w)).withColumn("next", F.lead("id").over(w))
    brief = brief.where("before IS NOT NULL OR next IS NOT NULL").select("token", "id", "n", "pos")
    long = rows.where("n_short < size(prefix)").select("id", "n", "n_short", entry).where("pos >= n_short")
    return brief.unionByName(long.select("token", "id", "n", "pos"))


def in_lists(rows: DataFrame, limit: Fraction) -> DataFrame:
    """(token, id, n, pos, first, first_n, first_pos, small): entries of lists with several nodes, each with the list's first: the
    node with the largest share of its prefix in such lists. So lists of one group of near copies have few different firsts.
    Which node it is changes no result, only how much is left for later. small: whether some node has the token in its shorter
    prefix; only such lists can hold the first meeting of a pair that is alike."""
    entries = stored(entries_of(rows), "entries")
    met = narrow(stored(entries.groupBy("id").agg(F.count(F.lit(1)).alias("met")), "met"))
    length = F.col("n") - quotient(F.col("n").cast("long") * limit.numerator, limit.denominator) + 1
    alone = F.floor((1 - F.least(F.col("met") / length, F.lit(1.0))) * (1 << 20)).cast("long")
    small = F.col("pos") < shorter_prefix(limit, F.col("n"))
    ranked = entries.join(met, "id").select("token", "id", "n", "pos", small.alias("small"), (F.shiftleft(alone, 32) + F.pmod("id", F.lit(1 << 32))).alias("rank"))
    shape = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    lists = ranked.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.max("small").alias("small"), F.min_by("id", "rank").alias("first"), F.min_by(shape, "rank").alias("shape"))
    lists = lists.where("members > 1").select(
        "token", "members", "small", "first", F.shiftright("shape", 32).cast("int").alias("first_n"), F.col("shape").bitwiseAND(0xFFFFFFFF).cast("int").alias("first_pos")
    )
    lists = stored(lists, "lists")
    total = lists.agg(F.sum("members")).first()[0] or 0
    is_hot = F.col("members") > HOT_SHARE * total
    hot = F.broadcast(lists.where(is_hot).drop("members"))
    cold = entries.join(hot.select("token"), "token", "left_anti").join(lists.where(~is_hot).drop("members"), "token")
    return entries.join(hot, "token").unionByName(cold)


def meetings(held: DataFrame, sketches: DataFrame, limit: Fraction) -> DataFrame:
    """(token, n, pos, label, id, sketch, all also with _y): nodes that meet in a list, for held (token, id, n, pos, label, main), before any
    filter but length bands. Nodes that have the token in their shorter prefix probe; the others are only met. Probes outside a list's main
    label meet all of the list, those inside it only the nodes outside. Both sides are cut into blocks, so no task joins a whole long list."""
    outside, probes = F.col("label") != F.col("main"), F.col("pos") < shorter_prefix(limit, F.col("n"))
    parts = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    lists = held.groupBy("token").agg(
        F.array(parts(probes & outside), parts(probes & ~outside)).alias("xs"), F.array(parts(F.lit(True)), parts(outside)).alias("ys")
    ).where("ys[1] > 0 AND xs[0] + xs[1] > 0")
    members = held.join(narrow(stored(lists, "open-lists")), "token").join(sketches, "id")
    own = F.floor(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).cast("long")
    xs, ys = F.get("xs", "kind"), F.get("ys", "kind")
    part = lambda c: F.pmod(own, c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    on, carried = ["token", "kind", "band", "xpart", "ypart"], ["id", "n", "pos", "label", "sketch"]
    x = members.where(probes).withColumn("kind", F.when(outside, 0).otherwise(1)).withColumn("band", band(limit, F.col("n")))
    x = x.withColumn("xpart", part(xs)).withColumn("ypart", every(ys)).select(*on, *carried)
    kinds = F.array_compact(F.array(F.when(F.get("xs", F.lit(0)) > 0, 0), F.when(outside & (F.get("xs", F.lit(1)) > 0), 1)))
    # A probe meets sets that are no smaller: those of its own band and of the next.
    y = members.withColumn("kind", F.explode(kinds)).withColumn("band", F.explode(F.array(band(limit, F.col("n")) - 1, band(limit, F.col("n")))))
    y = y.withColumn("ypart", part(ys)).withColumn("xpart", every(xs)).select(*on, *[F.col(c).alias(f"{c}_y") for c in carried])
    return x.join(y, on)


def between_labels(held: DataFrame, sketches: DataFrame, limit: Fraction) -> DataFrame:
    """(a, b), a < b: pairs of nodes of different labels that meet in a list and pass all filters."""
    n, pos, n2, pos2 = (F.col(c) for c in ("n", "pos", "n_y", "pos_y"))
    twice = (n == n2) & (pos2 < shorter_prefix(limit, n2))
    found = meetings(held, sketches, limit).where(
        (F.col("label") != F.col("label_y")) & (n <= n2) & (~twice | (F.col("id") < F.col("id_y")) | (F.col("kind") == 1))
        & length_and_place(limit, n, pos, n2, pos2) & sketches_allow(limit, n, F.col("sketch"), n2, F.col("sketch_y"))
    )
    return found.select(F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b")).distinct()


def alike_sets(docs: DataFrame, k: int, limit: str, id_col: str, text_col: str, by_row: bool) -> DataFrame:
    """(doc, own, n, f1, f2, label): a row for each row of docs, with the node id that names its component."""
    share = Fraction(limit)
    texts = keyed(docs, id_col, text_col)
    table = frequencies(texts, k)
    every = stored(prefixes(texts, k, share, table), "prefixes")
    # An id of several rows gives each of its sets a number of its own; so does the missing id.
    several = every.where("n > 0").groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where(f"rows > 1 OR doc = {NULL_ID}")
    several = stored(several.select("doc", F.lit(True).alias("multi")), "several")
    repeats = not several.isEmpty()
    node = F.col("doc")
    if repeats:
        every = every.join(narrow(several), "doc", "left")
        node = F.when(F.col("multi"), F.xxhash64("doc", "f1", "f2")).otherwise(node)
        # Only the rows of such ids are shuffled.
        marked = texts.join(narrow(several), "doc", "left")
        texts = marked.where("multi IS NULL").unionByName(marked.where("multi").dropDuplicates(["doc", "own"])).drop("multi")
    every = every.withColumn("set_id", node)
    nodes = stored(every.where("n > 0").groupBy("f1", "f2").agg(F.min("set_id").alias("set_id")), "nodes")
    rows = every.join(narrow(nodes), ["set_id", "f1", "f2"]).withColumnRenamed("set_id", "id")
    rows = rows.dropDuplicates(["id"]) if repeats else rows
    info = stored(rows.select("id", "doc", "n", "f1", "f2", "sketch"), "sets-info")
    shared = stored(in_lists(rows, share), "shared")
    fits = length_and_place(share, F.col("n"), F.col("pos"), F.col("first_n"), F.col("first_pos"))
    stars = stored(shared.where((F.col("id") != F.col("first")) & fits).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct(), "stars")
    links = stored(verified(stars, info, texts, k, share), "links-1")
    labels = narrow(stored(components(links), "labels"))
    # Lists that still hold several labels: nodes outside the first node's label meet all others that differ.
    label = lambda df: df.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    main = labels.select(F.col("id").alias("first"), F.col("label").alias("main"))
    held = label(shared.where("small").select("token", "id", "n", "pos", "first")).join(main, "first", "left").withColumn("main", F.coalesce("main", "first"))
    held = stored(held.drop("first"), "labelled")
    rest = between_labels(held, info.select("id", "sketch"), share)
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    more = links.unionByName(stored(verified(rest, info, texts, k, share), "links-2"))
    named_rows = every.join(narrow(nodes.withColumnRenamed("set_id", "node")), ["f1", "f2"], "left")
    if repeats and not by_row:
        tied = named_rows.where(f"multi AND doc <> {NULL_ID} AND n > 0").select("doc", "node").distinct()
        hub = tied.groupBy("doc").agg(F.min("node").alias("v"))
        more = more.unionByName(tied.join(hub, "doc").select(F.col("node").alias("u"), "v").where("u <> v"))
    labels = components(more).withColumnRenamed("id", "node")
    named_rows = named_rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node", "set_id"))
    return named_rows.select("doc", "own", "n", "f1", "f2", "label")


def near_components(
    docs: DataFrame, k: int = 5, limit: str = "0.8", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs. component_id: the least id reachable by links."""
    rows = stored(alike_sets(docs, k, limit, id_col, text_col, False), "alike")
    least = narrow(stored(rows.groupBy("label").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"), "least"))
    real = lambda c: F.when(c != NULL_ID, c)
    # A document without shingles is alone, whatever its id's other rows hold.
    comp = F.when(F.col("n") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc"))
    return rows.join(least, "label", "left").select(real(F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real(comp).alias("component_id"))


def near_copies(docs: DataFrame, k: int = 5, limit: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, own): id (NULL_ID where it is missing) and xxhash64 of the text of every row that is a near copy of a row before it in
    the order of id and text hash. Rows of one id are judged each by its own text; rows equal in both are one."""
    rows = stored(alike_sets(docs, k, limit, id_col, text_col, True).where("n > 0").select("label", "doc", "own").distinct(), "alike")
    least = stored(rows.groupBy("label").agg(F.min(F.struct("doc", "own")).alias("keeper"), F.count(F.lit(1)).alias("many")).where("many > 1"), "keepers")
    found = rows.join(narrow(least), "label").where((F.col("doc") != F.col("keeper.doc")) | (F.col("own") != F.col("keeper.own")))
    return found.select("doc", "own")
