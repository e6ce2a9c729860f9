"""Training sample, logistic regression with standard errors, scores and bands."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .indicators import DEFAULT_SPEC
from .joins import with_small

FEATURES = [s.column for s in DEFAULT_SPEC]
CUT_OFF_MS = 240 * 60_000
Z95 = 1.959963984540054
#: Coefficients of a fit on one series (the events of sf0.01 as one symbol), for scoring without a model.
FROZEN = {
    "rsi_backward_14": 0.22649047481,
    "roc_14": -0.00002829786155,
    "roc_140": 0.00014642144562,
    "macd_diff": 0.02928614819,
    "sma_ratio_14": -3.52282386853,
    "sma_ratio_140": -82.65881018325,
    "bb_width_14": -0.00342460638,
    "bb_width_140": 0.00023651543,
}


class SeparationError(ValueError):
    """The labels can be told apart without error, so there is no maximum likelihood."""


def complete_rows(rows: DataFrame) -> DataFrame:
    return rows.na.drop("any")


def before_cut_off(rows: DataFrame, span_ms: int = CUT_OFF_MS) -> DataFrame:
    """Rows strictly older than their symbol's newest by more than the span."""
    newest = stored(rows.groupBy("symbol").agg(F.max("open_time_ms").alias("__newest")), "newest")
    return with_small(rows, newest, "symbol").where(F.col("open_time_ms") < F.col("__newest") - span_ms).drop("__newest")


def training_sample(rows: DataFrame) -> DataFrame:
    return before_cut_off(complete_rows(rows))


def all_finite(features: list[str] = FEATURES) -> Column:
    """Whether all features of a complete row are finite: a zero close makes later rates of change infinite."""
    found = F.lit(True)
    for c in features:
        found = found & (F.abs(F.col(c)) < float("inf"))
    return found


def fit_logit(sample: DataFrame, features: list[str] = FEATURES, label: str = "spike_flag") -> GeneralizedLinearRegressionModel:
    """Unpenalised logistic regression without an intercept."""
    wild = sample.where(" OR ".join(f"isnan({c}) OR abs({c}) = double('Infinity')" for c in features)).count()
    if wild:
        raise ValueError(f"{wild} rows have features that aren't finite")
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(sample).select("__x", F.col(label).cast("double").alias("__y"))
    limit = 100
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="__x", labelCol="__y", fitIntercept=False, regParam=0.0,
        solver="irls", tol=1e-10, maxIter=limit,
    ).fit(data)
    made = model.summary
    errors = made.coefficientStandardErrors
    if made.numIterations >= limit or any(not math.isfinite(e) or e > 1e6 for e in errors) or made.deviance < 1e-6 * max(1, made.numInstances):
        raise SeparationError("the fit doesn't converge: the labels are separable")
    return model


def coefficient_table(model: GeneralizedLinearRegressionModel, sample: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    s = model.summary
    rows = [
        (n, float(b), float(e), float(z), float(p), float(b - Z95 * e), float(b + Z95 * e))
        for n, b, e, z, p in zip(features, model.coefficients, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    ]
    return sample.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, z double, p_value double, ci_low double, ci_high double"
    )


def probability(coefficients: dict[str, float] = FROZEN) -> Column:
    total = None
    for name, value in coefficients.items():
        term = F.lit(value) * F.col(name)
        total = term if total is None else total + term
    return 1 / (1 + F.exp(-total))


def score(rows: DataFrame, coefficients: dict[str, float] = FROZEN) -> DataFrame:
    return rows.withColumn("predicted_proba_spike", probability(coefficients))


def signal_band(short: float = 0.01, long: float = 0.1) -> Column:
    """short, long or flat; none where there is no probability."""
    p = F.col("predicted_proba_spike")
    return F.when(p < short, "short").when(p > long, "long").when(p.isNotNull(), "flat")


def save(model: GeneralizedLinearRegressionModel, path: str) -> None:
    """Keeps a fit in the shared folder; overwrites one of that name."""
    model.write().overwrite().save(path)


def saved(path: str) -> GeneralizedLinearRegressionModel:
    return GeneralizedLinearRegressionModel.load(path)


def coefficients_of(model: GeneralizedLinearRegressionModel, features: list[str] = FEATURES) -> dict[str, float]:
    return dict(zip(features, map(float, model.coefficients), strict=True))
