"""A logistic fit for each symbol, by grouped Newton steps, and scores by the newest fit whose sample had ended.

A step is one pass over the rows of the symbols that haven't converged: sums of X'WX and X'r by symbol, added up before the shuffle. The systems, as
many rows as there are symbols, are solved in tasks. A symbol leaves when its step is small; one whose labels can be told apart, or whose
system has no inverse, is told so in its status and has no coefficients.

Defined cases: rows with a feature or label that is missing or not finite are left out; a symbol with one label only, or with fewer
rows than features, is separable or singular; a symbol without rows left isn't in the result; ties and repeated rows count; an empty
table gives an empty result. Symbols and the name of a fit must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .joins import with_small
from .model import FEATURES, Z95

#: Steps at most, the relative step at which a symbol has converged, and the deviance a row below which labels are separable.
STEPS, SMALL, APART = 40, 1e-9, 1e-6
#: log-odds beyond which a row's weight is nothing.
LIMIT = 700.0


def _sums(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """A row a symbol: sums of w x_i x_j (upper triangle), r x_i, -2 log likelihood, rows, labels."""
    n, x = len(features), [F.element_at("__x", i + 1) for i in range(len(features))]
    eta = sum((F.element_at("__b", i + 1) * x[i] for i in range(n)), F.lit(0.0))
    held = rows.withColumn("__eta", F.greatest(F.least(eta, F.lit(LIMIT)), F.lit(-LIMIT)))
    held = held.withColumn("__p", 1 / (1 + F.exp(-F.col("__eta"))))
    held = held.withColumns({"__w": F.col("__p") * (1 - F.col("__p")), "__r": F.col("__y") - F.col("__p")})
    loss = 2 * F.when(F.col("__eta") > 0, F.col("__eta") * (1 - F.col("__y")) + F.log1p(F.exp(-F.col("__eta")))).otherwise(F.log1p(F.exp(F.col("__eta"))) - F.col("__eta") * F.col("__y"))
    sums = [F.sum(F.col("__w") * x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(F.col("__r") * x[i]) for i in range(n)]
    return held.groupBy("symbol").agg(F.array(*sums).alias("__sums"), F.sum(loss).alias("__deviance"), F.count(F.lit(1)).alias("n_rows"), F.first("__b").alias("__b"))


STATE = "symbol string, b array<double>, se array<double>, n_rows long, deviance double, steps int, status string"


def _stepped(sums: DataFrame, n: int, step: int) -> DataFrame:
    upper = np.triu_indices(n)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for s, sums, deviance, rows, b in zip(part["symbol"], part["__sums"], part["__deviance"], part["n_rows"], part["__b"], strict=True):
                flat, b = np.array(sums), np.array(b)
                matrix = np.zeros((n, n))
                matrix[upper] = flat[: len(upper[0])]
                matrix += np.triu(matrix, 1).T
                scale = 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300))  # columns of one size
                scaled = matrix * np.outer(scale, scale)
                fine = np.isfinite(scaled).all() and np.linalg.cond(scaled) < 1e13
                if deviance < APART * rows:
                    out.append((s, None, None, rows, deviance, step, "separable"))
                elif not fine:
                    out.append((s, None, None, rows, deviance, step, "singular" if step <= 1 else "separable"))
                else:
                    inverse = np.linalg.inv(scaled) * np.outer(scale, scale)
                    move = inverse @ flat[len(upper[0]) :]
                    done = bool((np.abs(move) <= SMALL * np.maximum(np.abs(b), np.sqrt(np.diag(inverse)))).all())
                    out.append((s, (b + move).tolist(), np.sqrt(np.diag(inverse)).tolist(), rows, deviance, step, "converged" if done else "open"))
            yield pd.DataFrame(out, columns=["symbol", "b", "se", "n_rows", "deviance", "steps", "status"])

    return sums.mapInPandas(solve, STATE)


def fit_by_symbol(sample: DataFrame, features: list[str] = FEATURES, label: str = "spike_flag", steps: int = STEPS) -> DataFrame:
    """(symbol, status, steps, n_rows, deviance, b, se): unpenalised logistic fits without an intercept. b and se follow `features`; status is
    converged, separable, singular, or open after all steps."""
    finite = F.col(label).isNotNull() & F.col("symbol").isNotNull()
    for c in features:
        finite = finite & (F.abs(F.nanvl(c, F.lit(None).cast("double"))) < float("inf"))
    rows = stored(sample.where(finite).select("symbol", F.array(*[F.col(c).cast("double") for c in features]).alias("__x"), F.col(label).cast("double").alias("__y")), "fit-rows")
    n, done = len(features), []
    now = stored(_stepped(_sums(rows.withColumn("__b", F.array(*[F.lit(0.0)] * n)), features, label), n, 1), "fit-step")
    for step in range(2, steps + 1):
        done.append(now.where("status <> 'open'"))
        active = now.where("status = 'open'").select("symbol", F.col("b").alias("__b"))
        many = active.count()
        if not many:
            break
        held = with_small(rows, active, "symbol", rows=many * n).where("__b IS NOT NULL")
        now = stored(_stepped(_sums(held, features, label), n, step), "fit-step")
    else:
        done.append(now)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("symbol", "status", "steps", "n_rows", "deviance", "b", "se")


def fit_table(fits: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(symbol, status, n_rows, term, coef, std_err, z, p_value, ci_low, ci_high): a row for each symbol and term of the converged fits, and one without
    a term for each other."""
    names = F.array(*[F.lit(c) for c in features])
    terms = F.explode_outer(F.when(F.col("status") == "converged", F.arrays_zip(names.alias("term"), F.col("b").alias("coef"), F.col("se").alias("std_err"))))
    rows = fits.select("symbol", "status", "n_rows", terms.alias("t")).select("symbol", "status", "n_rows", F.col("t.term").alias("term"), F.col("t.coef").alias("coef"), F.col("t.std_err").alias("std_err"))
    z = F.col("coef") / F.col("std_err")

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return z.map(lambda v: None if v is None or v != v else erfc(abs(v) / sqrt(2)))

    return rows.withColumns({
        "z": z, "p_value": tail(z), "ci_low": F.col("coef") - Z95 * F.col("std_err"), "ci_high": F.col("coef") + Z95 * F.col("std_err"),
    })


def saved_fits(fits: DataFrame, path: str, ended_ms: int) -> None:
    """Adds a run's converged fits to those saved at path. ended_ms: the time before which all rows of the run lie. Saved again, it stays one."""
    rows = fits.where("status = 'converged'").select("symbol", "n_rows", "b", "se")
    rows.write.mode("overwrite").parquet(f"{path}/ended_ms={ended_ms}")


def fits_of(spark, path: str) -> DataFrame:
    """(symbol, n_rows, b, se, ended_ms) of all saved runs."""
    return spark.read.schema("symbol string, n_rows long, b array<double>, se array<double>, ended_ms long").parquet(path)


def score_as_of(rows: DataFrame, fits: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """rows with predicted_proba_spike by their symbol's newest fit that ended at or before them, and its ended_ms; both are null where there is
    none. A symbol's fits, one a run, travel as one array."""
    each = fits.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ended_ms", "b"))).alias("__fits"))
    each = stored(each, "fits")
    held = with_small(rows, each, "symbol", width=F.size("__fits") * (len(features) + 1))
    known = F.filter("__fits", lambda f: f["ended_ms"] <= F.col("open_time_ms"))
    held = held.withColumn("__fit", F.try_element_at(known, F.lit(-1)))
    held = held.withColumns({f"__b{i}": F.element_at("__fit.b", i + 1) for i in range(len(features))}).withColumn("ended_ms", F.col("__fit.ended_ms"))
    total = sum((F.col(f"__b{i}") * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    made = held.withColumn("predicted_proba_spike", 1 / (1 + F.exp(-total)))
    return made.drop("__fits", "__fit", *[f"__b{i}" for i in range(len(features))])
