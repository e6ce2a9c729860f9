"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source has a mean repetition rate: its target share of the mix over its present share of UTF-8 bytes.
A document's count is the inverse of the Poisson distribution with that mean at a uniform number hashed
from seed and id; the document is exploded by its count and the whole mix is sorted by a hash.

Defined cases: a null text has no bytes; a null source is a source of its own, named by None in the weights;
sources without a weight, and all documents if no source has bytes, leave the mix; rows that repeat an id get
the same count; ties of the shuffle key are ordered by id and copy; an empty table gives an empty mix. Other columns pass
through; one named like an added column (n_copies, copy, shuffle_key) is replaced. Ids may be of any type that casts to string.
Texts of any length travel as they are; only their bytes are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carry, named, others, stored, unpacked, with_small

SEED = "mix-1"
UNIT = float(2**52)
#: Values of an array that count as one row of a table to broadcast.
ROW_VALUES = 8
ADDED = ["n_copies", "copy", "shuffle_key"]
#: Copies of a document that one row may grow into within its task.
GROWTH = 64


def hashed(seed: str, *parts: Column) -> Column:
    """52 bits of MD5 over seed and parts, as a long."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def poisson_cdf(rates: DataFrame, source_col: str) -> DataFrame:
    """(source_col, __low, __cdf): P(X <= k) for k = __low, __low + 1, ... up to where the tail is below 2**-52. The tail
    below __low is less than e**-70 and adds nothing to these sums. One row a k, about 24 sqrt(rate) of them, then a window."""
    rate, low, k = F.col("mean_rate"), F.col("__low"), F.col("__k")
    terms = rates.withColumn("__low", F.when(rate > 400, F.floor(rate - 12 * F.sqrt(rate) - 40)).otherwise(0).cast("long"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("long")
    terms = terms.withColumn("__k", F.explode(F.sequence(low, last)))
    # The first term by Stirling's series where low isn't 0.
    stirling = low * F.log(rate / low) + (low - rate) - 0.5 * F.log(2 * math.pi * low) - 1 / (12 * low) + 1 / (360 * F.pow(low, F.lit(3)))
    step = F.when(k > low, F.log(rate / k)).when(low == 0, -rate).otherwise(stirling)
    w = Window.partitionBy(source_col).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = terms.withColumn("__log_p", F.sum(step).over(w)).withColumn("__c", F.sum(F.exp("__log_p")).over(w))
    return made.groupBy(source_col, "__low").agg(F.array_sort(F.collect_list("__c")).alias("__cdf"))


def source_rates(
    docs: DataFrame, weights: dict | None = None, total: float | None = None, source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(source_col, mean_rate). No weights: all sources that have bytes weigh the same. total: bytes of the mix,
    by default those of docs."""
    size = F.sum(F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long")).alias("__size")
    sizes = stored(docs.groupBy(named(source_col).alias(source_col)).agg(size), "source-sizes")
    if total is None:
        total = sizes.agg(F.sum("__size")).first()[0]
    sizes = sizes.where(F.col("__size") > 0)
    if weights is None:
        sizes = sizes.withColumn("__weight", F.lit(1.0))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs, "__name string, __weight double")
        sizes = sizes.join(given, sizes[source_col].eqNullSafe(given["__name"])).drop("__name")
        sizes = sizes.where(F.col("__weight") > 0)
    whole = sizes.agg(F.sum("__weight").alias("weights")).first()
    share = F.col("__weight") / F.lit(whole["weights"] or 1.0)
    rate = share * F.lit(float(total or 0)) / F.col("__size").cast("double")
    return sizes.select(source_col, rate.alias("mean_rate"))


def values_up_to(sums: Column, u: Column) -> Column:
    """How many of the rising sums are at most u, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(sums).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sums) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        low, high = s["low"], s["high"]
        mid = F.shiftright(low + high, 1)
        up = (low < high) & (F.get(sums, mid) <= u)
        return F.struct(F.when(up, mid + 1).otherwise(low).alias("low"), F.when(up | (low >= high), high).otherwise(mid).alias("high"))

    return F.aggregate(steps, start, halve)["low"]


def mix_sources(
    docs: DataFrame, weights: dict | None = None, total: float | None = None, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """docs repeated by their counts, with n_copies, copy (1 to n_copies) and shuffle_key, sorted by the last. A document of
    many copies is first cut into rows of at most GROWTH copies each, which are dealt out before they grow."""
    rates = stored(source_rates(docs, weights, total, source_col, text_col).withColumnRenamed(source_col, "source"), "rates")
    table = stored(poisson_cdf(rates, "source"), "poisson")
    names = others(docs, *ADDED)
    uniform = hashed(seed, named(id_col)).cast("double") / UNIT
    rows = docs.select(carry(docs, names), named(id_col).alias("id"), named(source_col).alias("source"), uniform.alias("u"))
    rows = with_small(rows, table, "source", width=F.ceil(F.size("__cdf") / ROW_VALUES))
    rows = rows.withColumn("n_copies", (F.col("__low") + values_up_to(F.col("__cdf"), F.col("u"))).cast("int"))
    rows = rows.where(F.col("n_copies") >= 1).select("own", "id", "n_copies")
    few = rows.withColumn("first", F.lit(1)).withColumn("last", F.col("n_copies"))
    top = rates.agg(F.max("mean_rate")).first()[0] or 0.0
    if top + 12 * math.sqrt(top) + 40 > GROWTH:
        # Only the largest part of each row's copies differs in length, so hashing id and part spreads them.
        many = rows.where(F.col("n_copies") > GROWTH).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n_copies"), F.lit(GROWTH))))
        many = many.withColumn("last", F.least(F.col("first") + GROWTH - 1, F.col("n_copies")))
        few = few.where(F.col("n_copies") <= GROWTH).unionByName(many.repartition("id", "first"))
    grown = few.select("own", "id", "n_copies", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("copy"))
    grown = grown.withColumn("shuffle_key", hashed(seed + "-order", F.col("id"), F.col("copy")))
    return grown.orderBy("shuffle_key", "id", "copy").select(*unpacked(names), *ADDED)
