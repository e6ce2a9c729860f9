"""Quality rules: a few base rules, then robust multivariate outliers per language and source.

Each document gives a vector of transformed statistics, rounded to 1 / GRID, so equal vectors are one row with a count. For every
(language, source) the minimum covariance determinant is searched over all rows: from four deterministic starts (median deviations;
the correlations of tanh scores; those of spatial signs; the nearest half), concentration steps take the nearest H of the rows, each
to the exact row, until the determinant falls no more; the least determinant of the starts is kept. Spark counts and sums the vectors
by group, start and distance bin, then those of the bin in which the nearest H end by distance; what a group's estimate is made
from is one row. Vectors at that last distance share what is left of H. All sums are of whole numbers, so neither the order of
rows nor a task run again changes a bit of an estimate. FLOORS are added to every covariance, within the determinant too.
Documents far from their group by Mahalanobis distance are rejected. Groups with fewer than MIN_ROWS rows use their language's
estimate, and those of small languages that of all rows.

Defined cases: a null text has no words and fails the base rules; null languages and sources are values of their own;
without rows to learn from, the base rules decide; rows that repeat an id are judged each by its text, and equal rows
alike; other columns pass through, and one named like an added column (COUNTS, base_failed, distance, group_rows,
group_level, kept) is replaced by it; an empty table gives an empty result. Ids may be of any type. Texts are
counted whole, whatever their length; rows at equal distance share their fate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, carry, named, others, stored, unpacked, with_small
from .words import cuts, mix, owner, release, split, word_hashes

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
P = 5
#: Least deviation of each transformed statistic: keeps estimates of near-constant statistics from being singular. The last two
#: are small enough for repeated lines alone, and repeated words below MAX_REPEAT alone, to reach CUT: 1 / 0.17^2 and 0.3 / 0.098^2.
FLOORS = (0.5, 0.08, 0.1, 0.17, 0.098)
H, MIN_ROWS = 0.75, 100
#: Probability of a larger distance for a clean Gaussian row.
TAIL = 1e-5
#: Statistics are rounded to 1 / GRID; distances are counted in bins of 1 / BINS of their logarithm.
GRID, BINS = 64, 256
#: A determinant that falls by less than this share falls no more.
STILL = 1e-9
#: A group of at most so many different vectors (some 100 bytes each) is searched in one task; larger ones, step by step, in many.
FEW = 30_000
#: Scores of the starts are summed as whole numbers of 1 / UNIT.
STARTS, UNIT = ("deviations", "tanh", "signs", "half"), 1 << 20


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_cut(p: int, q: float) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(p / 2, mid / 2) < q else (low, mid)
    return high


#: Makes the spread of the nearest H rows of a Gaussian that of all rows.
SPREAD = H / gamma_p((P + 2) / 2, chi2_cut(P, H) / 2)
CUT = chi2_cut(P, 1 - TAIL)


def repeated_words(words: list, k: int = WINDOW) -> int:
    """Words in k-word windows that are found twice or more."""
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - k + 1):
        places.setdefault(tuple(words[i : i + k]), []).append(i)
    covered, end = 0, 0
    for i in sorted(i for v in places.values() if len(v) > 1 for i in v):
        covered += i + k - max(end, i)
        end = i + k
    return covered


def _stats(texts: pa.Array) -> list[np.ndarray]:
    codes, distinct, starts = split(texts)
    counts = np.diff(starts)
    repeated = np.zeros(len(texts), np.int64)
    n = len(codes)
    if n >= WINDOW:
        words = word_hashes(distinct)[codes]
        total = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            total = mix(total ^ words[j : n - WINDOW + 1 + j])
        text = owner(starts)[: len(total)]
        inside = starts[1:][text] - np.arange(len(total)) >= WINDOW
        key = mix(total[inside] ^ mix(text[inside].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        # The hashes only say which texts may repeat a window; those are compared word by word.
        for i in np.unique(text[inside][order[1:][same]]):
            repeated[i] = repeated_words(codes[starts[i] : starts[i + 1]].tolist())
    chars, symbols, lines, doubles = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, t in enumerate(texts.to_pylist()):
        if t:
            chars[i] = len(t) - sum(map(t.count, SPACES))
            symbols[i] = sum(map(t.count, SYMBOLS))
            real = [x for x in t.split("\n") if x.strip(SPACES)]
            lines[i], doubles[i] = len(real), len(real) - len(set(real))
    return [counts, chars, symbols, doubles, repeated, lines]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
ADDED = [*COUNTS, "base_failed", "distance", "group_rows", "group_level", "kept"]
XS = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def counts_udf():
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        parts = [_stats(texts.slice(a, b - a)) for a, b in cuts(texts)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(COUNTS)
        del parts, texts
        release()
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))

    return counts


def key_of(lang: Column, source: Column | None = None) -> Column:
    """The name of a language's rows, or of those of a language and source."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.concat(F.lit("1"), part(lang)) if source is None else F.concat(F.lit("2"), part(lang), F.lit("\x1f"), part(source))


def own_columns(docs: DataFrame, text_col: str, keep_text: bool) -> list[str]:
    return others(docs, *ADDED, *([] if keep_text else [text_col]))


def with_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """(own, lang_key, key, the counts, base_failed, x0 to x4): own holds the other columns, x the rounded statistics."""
    own = carry(docs, own_columns(docs, text_col, keep_text))
    lang, source = named(lang_col), named(source_col)
    rows = docs.select(own, key_of(lang).alias("lang_key"), key_of(lang, source).alias("key"), named(text_col).alias("text"))
    rows = rows.withColumn("s", counts_udf()(F.col("text"))).select("own", "lang_key", "key", *[F.col(f"s.{c}").alias(c) for c in COUNTS])
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratio = lambda c, d: F.sqrt(F.col(c) / d)
    values = [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), ratio("n_symbols", n), ratio("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), ratio("n_repeat_words", n)]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumns({"base_failed": failed} | {x: F.round(v * GRID).cast("long") for x, v in zip(XS, values, strict=True)})


def distance(mu: Column, inv: Column) -> Column:
    """The squared Mahalanobis distance of x0 to x4; mu and inv in units of the statistics."""
    off = [F.col(x) / F.lit(float(GRID)) - F.get(mu, F.lit(i)) for i, x in enumerate(XS)]
    total = None
    for i, j in PAIRS:
        term = off[i] * off[j] * F.get(inv, F.lit(P * i + j)) * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


PARAMS = "key string, start int, n long, h long, mu array<double>, inv array<double>, det double"


def estimate(mu: np.ndarray, cov: np.ndarray) -> tuple[list, list, float]:
    cov = cov + np.diag(np.square(FLOORS))
    return mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def symmetric(values) -> np.ndarray:
    out = np.zeros((P, P))
    for v, (i, j) in zip(values, PAIRS, strict=True):
        out[i, j] = out[j, i] = v
    return out


def nearest(n: int, share: float = H) -> int:
    return math.ceil(share * n)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARAMS.split(", ")])


def medians(cells: DataFrame) -> DataFrame:
    """(key, n, med, dev): of each statistic the median and 1.4826 times the median deviation, in units of 1 / GRID."""
    grid = cells.select("key", "many", F.posexplode(F.array(*XS)).alias("j", "v")).groupBy("key", "j", "v").agg(F.sum("many").alias("many"))
    own = Window.partitionBy("key", "j")

    def median(rows: DataFrame, by: str) -> DataFrame:
        placed = rows.withColumn("n", F.sum("many").over(own)).withColumn("to", F.sum("many").over(own.orderBy(by)))
        return placed.where(F.col("to") >= F.floor((F.col("n") + 1) / 2)).groupBy("key", "j").agg(F.min(by).alias("m"), F.first("n").alias("n"))

    mid = median(grid, "v").select("key", "j", F.col("m").alias("med"), "n")
    off = grid.join(mid.drop("n"), ["key", "j"]).groupBy("key", "j", F.abs(F.col("v") - F.col("med")).alias("off")).agg(F.sum("many").alias("many"))
    dev = median(off, "off").select("key", "j", F.col("m").alias("dev"))
    found = mid.join(dev, ["key", "j"]).groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "med", "dev"))).alias("p"))
    return found.select("key", "n", F.col("p.med").alias("med"), F.col("p.dev").alias("dev"))


def starts_of(cells: DataFrame, middle: DataFrame) -> DataFrame:
    """Every group's starting estimates. The last one's first step takes the nearest half instead of the nearest H."""
    z = [
        (F.col(x) - F.get("med", F.lit(i))) / GRID / F.sqrt(F.pow(1.4826 * F.get("dev", F.lit(i)) / GRID, F.lit(2.0)) + FLOORS[i] ** 2)
        for i, x in enumerate(XS)
    ]
    rows = with_small(cells, middle, "key").select("key", "n", "med", "dev", "many", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    length = F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)))
    rows = rows.withColumn("z", length)
    whole = lambda c: F.sum(F.round(c * UNIT).cast("long") * F.col("many"))
    sign = lambda i: F.when(F.col("z") > 0, F.col(f"z{i}") / F.col("z")).otherwise(0.0)
    sums = rows.groupBy("key", "n", "med", "dev").agg(
        F.array(*[whole(F.tanh(f"z{i}") * F.tanh(f"z{j}")) for i, j in PAIRS]).alias("tanh"), F.array(*[whole(sign(i) * sign(j)) for i, j in PAIRS]).alias("signs")
    )

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                mu, dev = np.array(r.med) / GRID, 1.4826 * np.array(r.dev) / GRID
                for s, name in enumerate(STARTS):
                    turn = np.eye(P)
                    if name in ("tanh", "signs"):
                        made = symmetric(np.array(getattr(r, name), float)) + np.eye(P)
                        size = np.sqrt(np.diag(made))
                        turn = made / np.outer(size, size)
                    out.append((r.key, s, r.n, nearest(r.n, 0.5 if name == "half" else H), *estimate(mu, turn * np.outer(dev, dev))[:2], math.inf))
            yield _frame(out)

    return sums.mapInPandas(make, PARAMS)


def _sums() -> list[Column]:
    many = F.col("many")
    return [F.sum("many").alias("many"), *[F.sum(F.col(x) * many).alias(f"s{i}") for i, x in enumerate(XS)], *[F.sum(F.col(XS[i]) * F.col(XS[j]) * many).alias(f"q{i}{j}") for i, j in PAIRS]]


SUMS = ["many", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]


def _split(rows: DataFrame, by: str, need: Column) -> DataFrame:
    """Of each key and start: the sums of the rows before the one, in the order of `by`, that takes the count to `need`, and of that one."""
    w = Window.partitionBy("key", "start").orderBy(by)
    placed = rows.withColumn("to", F.sum("many").over(w))
    before, at = F.col("to") < need, (F.col("to") >= need) & (F.col("to") - F.col("many") < need)
    pick = lambda test: F.array(*[F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)) for c in SUMS])
    return placed.groupBy("key", "start").agg(pick(before).alias("before"), pick(at).alias("at"), F.max(F.when(at, F.col(by))).alias("edge"), *[F.first(c).alias(c) for c in ("n", "h")])


def concentrate(cells: DataFrame, params: DataFrame, count: int) -> DataFrame:
    """The next estimate of each key and start: mean and covariance of the h nearest rows, to the exact row."""
    d = distance(F.col("mu"), F.col("inv"))
    near = with_small(cells, params, "key", rows=count).where(F.col("mu").isNotNull()).withColumn("d", d).withColumn("bin", F.floor(F.log1p("d") * BINS).cast("long"))
    binned = near.groupBy("key", "start", "n", "h", "bin").agg(*_sums())
    rough = stored(_split(binned, "bin", F.col("h")), "mcd-bins")
    ends = rough.select("key", "start", F.col("edge").alias("end"), F.col("before").alias("base"))
    inner = with_small(cells, params.drop("n", "h").join(rough.select("key", "start", "n", "h", F.col("edge").alias("end"), F.col("before")[0].alias("had")), ["key", "start"]), "key", rows=count)
    inner = inner.where(F.col("mu").isNotNull()).withColumn("d", d).where(F.floor(F.log1p("d") * BINS) == F.col("end"))
    fine = _split(inner.groupBy("key", "start", "n", "h", "had", "d").agg(*_sums()), "d", F.col("h") - F.col("had"))
    old = params.select("key", "start", F.col("det").alias("old"))
    both = fine.join(ends, ["key", "start"]).join(old, ["key", "start"])

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [next_estimate(r.n, r.h, [int(a) + int(b) for a, b in zip(r.base, r.before, strict=True)], r.at, r.old) for r in frame.itertuples()]
            rows = [(r.key, r.start, r.n, nearest(r.n), *m[:3]) for r, m in zip(frame.itertuples(), made, strict=True)]
            yield _frame(rows).assign(fell=[m[3] for m in made])

    return both.mapInPandas(make, PARAMS + ", fell boolean")


def next_estimate(n: int, h: int, had: list[int], at, old: float) -> tuple[list, list, float, bool]:
    """(mu, inv, det, whether it fell) from the sums of the rows that are nearer than the h-th and of those as far as it."""
    share = (int(h) - had[0]) / int(at[0])
    total = [a + share * int(b) for a, b in zip(had, at, strict=True)]
    mu = np.array(total[1 : P + 1]) / h
    cov = symmetric(total[P + 1 :]) / h - np.outer(mu, mu)
    mu, inv, det = estimate(mu / GRID, cov / GRID**2 * (SPREAD if h < n else 1.0))
    if h != nearest(n):  # a determinant of fewer rows compares with no other
        return mu, inv, math.inf, True
    return mu, inv, det, bool(det < old - STILL)


def search(key: tuple, cells: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
    """The same steps over a group's few vectors, to the end, bit for bit."""
    x, many = cells[XS].to_numpy(np.int64), cells["many"].to_numpy(np.int64)
    sums = np.concatenate([many[:, None], x * many[:, None], np.stack([x[:, i] * x[:, j] * many for i, j in PAIRS], axis=1)], axis=1)
    out = []
    for r in params.itertuples():
        mu, inv, h, det, fell = r.mu, r.inv, r.h, math.inf, True
        while fell:
            off = [x[:, i] / float(GRID) - mu[i] for i in range(P)]
            d = 0
            for i, j in PAIRS:
                d = d + off[i] * off[j] * inv[P * i + j] * (1.0 if i == j else 2.0)
            d = np.maximum(d, 0.0)
            order = np.argsort(d, kind="stable")
            edge = d[order[np.searchsorted(np.cumsum(many[order]), h)]]
            had, at = sums[d < edge].sum(axis=0), sums[d == edge].sum(axis=0)
            mu, inv, det, fell = next_estimate(r.n, h, [int(v) for v in had], at, det)
            h = nearest(r.n)
        out.append((r.key, r.start, r.n, h, mu, inv, det))
    return _frame(out)


def used_groups(rows: DataFrame) -> DataFrame:
    """(key, used, level): for each language and source, whose estimate it uses."""
    groups = rows.groupBy("key", "lang_key").agg(F.count_if(~F.col("base_failed")).alias("n"))
    groups = groups.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang_key")))
    own, lang = F.col("n") >= MIN_ROWS, F.col("lang_n") >= MIN_ROWS
    return groups.select("key", "lang_key", F.when(own, F.col("key")).when(lang, F.col("lang_key")).otherwise("0").alias("used"), F.when(own, 2).when(lang, 1).otherwise(0).alias("level"))


def fit_groups(rows: DataFrame) -> DataFrame:
    """(key, mu, inv, group_rows, group_level) for each language and source. rows: what with_counts gives, stored."""
    used = stored(used_groups(rows), "mcd-used")
    fit = rows.where(~F.col("base_failed")).groupBy("key", "lang_key", *XS).agg(F.count(F.lit(1)).alias("many"))
    own = F.array("key", "lang_key", F.lit("0"))
    names = used.select(F.col("used").alias("name")).distinct().withColumn("wanted", F.lit(True))
    fit = with_small(fit.select(F.explode(own).alias("name"), *XS, "many"), names, "name").where("wanted")
    cells = stored(fit.groupBy(F.col("name").alias("key"), *XS).agg(F.sum("many").alias("many")), "mcd-vectors")
    params = stored(starts_of(cells, stored(medians(cells), "mcd-medians")), "mcd")
    sizes = stored(cells.groupBy("key").agg((F.count(F.lit(1)) <= FEW).alias("few")), "mcd-sizes")
    few = with_small(cells, sizes, "key").where("few").drop("few").groupBy("key")
    params = params.join(sizes, "key")
    done = [few.cogroup(params.where("few").drop("few").groupBy("key")).applyInPandas(search, PARAMS)]
    params = stored(params.where("NOT few").drop("few"), "mcd")
    while count := params.count():
        params = stored(concentrate(cells, params, count), "mcd")
        done.append(params.where(~F.col("fell")).drop("fell"))
        params = params.where("fell").drop("fell")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    best = found.groupBy("key").agg(F.min_by(F.struct("n", "mu", "inv"), F.struct("det", "start")).alias("b"))
    best = best.select(F.col("key").alias("used"), F.col("b.n").alias("group_rows"), F.col("b.mu").alias("mu"), F.col("b.inv").alias("inv"))
    level = F.when(F.col("mu").isNotNull(), F.col("level")).alias("group_level")
    return stored(used.join(stored(best, "mcd-best"), "used", "left").select("key", "mu", "inv", "group_rows", level), "mcd-groups")


def judge(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with distance (squared Mahalanobis) and kept."""
    joined = with_small(rows, groups, "key").withColumn("distance", distance(F.col("mu"), F.col("inv")))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs with the columns ADDED; keep_text: or without the text. Texts are read and counted once, and written with their
    counts to the shared folder; they are never shuffled."""
    rows = stored(with_counts(docs, text_col, lang_col, source_col, keep_text), "quality")
    judged = judge(rows, fit_groups(rows))
    return judged.select(*unpacked(own_columns(docs, text_col, keep_text)), *ADDED)
