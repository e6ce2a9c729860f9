"""The logistic fit as SQL: Newton steps in a recursive query, each an elimination of the normal equations.

Only the driver's oracle reads it; the engine fits by Spark's own solver.
"""

from __future__ import annotations

STEPS = 40


def eliminated(source: str, n: int, width: int, keep: str) -> str:
    """A query that solves n rows a{i}_{j} (columns n to width - 1 are right sides) of `source` and hands on the columns `keep`. The
    matrix is symmetric and positive, so the order of the rows does."""
    for k in range(n):
        made = []
        for i in range(n):
            for j in range(k + 1, width):
                own = f"a{k}_{j} / a{k}_{k}"
                made.append(f"{own} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * ({own}) AS a{i}_{j}")
        source = f"(SELECT {keep}, {', '.join(made)} FROM {source})"
    return source


def normal_equations(features: list[str]) -> str:
    """Sums over rows with weight w and rest r: the matrix in columns 0 to n - 1, the gradient in column n."""
    n = len(features)
    sums = [f"sum(w * {features[i]} * {features[j]}) AS a{i}_{j}" for i in range(n) for j in range(n)]
    return ", ".join(sums + [f"sum(r * {x}) AS a{i}_{n}" for i, x in enumerate(features)])


def fitted(sample: str, label: str, features: list[str]) -> str:
    """CTEs newton (step, b0, b1, ...) and inverse (one row, a{i}_{n + i} the variances) over the rows of `sample`."""
    n = len(features)
    b = [f"b{i}" for i in range(n)]
    score = " + ".join(f"b{i} * {x}" for i, x in enumerate(features))
    rows = lambda source: (
        f"(SELECT *, p * (1 - p) AS w, {label} - p AS r FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM {source}, {sample}))"
    )
    solved = eliminated(f"(SELECT step, {', '.join(b)}, {normal_equations(features)} FROM {rows('newton')} GROUP BY ALL)", n, n + 1, "step, " + ", ".join(b))
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS a{i}_{n + j}" for i in range(n) for j in range(n))
    whole = f"(SELECT *, {unit} FROM (SELECT {', '.join(f'sum(w * {features[i]} * {features[j]}) AS a{i}_{j}' for i in range(n) for j in range(n))} FROM {rows('best')}))"
    return f"""newton AS (
  SELECT 0 AS step, {', '.join(f'0.0::DOUBLE AS {x}' for x in b)}
  UNION ALL
  SELECT step + 1, {', '.join(f'b{i} + a{i}_{n}' for i in range(n))} FROM {solved} WHERE step < {STEPS}
), best AS (SELECT {', '.join(b)} FROM newton WHERE step = {STEPS}),
inverse AS (SELECT {', '.join(f'a{i}_{n + i}' for i in range(n))} FROM {eliminated(whole, n, 2 * n, '0 AS one')})"""


def fitted_by(sample: str, label: str, features: list[str], by: str = "symbol") -> str:
    """CTEs newton (step, symbol, b0, ...), best (symbol, b0, ...) and inverse (symbol, a{i}_{n + i}): fitted() for each symbol by itself. fine: the
    symbols whose labels can't be told apart without error."""
    n = len(features)
    b = [f"b{i}" for i in range(n)]
    score = " + ".join(f"b{i} * {x}" for i, x in enumerate(features))
    rows = lambda source: (
        f"(SELECT *, p * (1 - p) AS w, {label} - p AS r FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM {source} JOIN {sample} USING ({by})))"
    )
    keep = f"step, {by}, " + ", ".join(b)
    solved = eliminated(f"(SELECT {keep}, {normal_equations(features)} FROM {rows('newton')} GROUP BY ALL)", n, n + 1, keep)
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS a{i}_{n + j}" for i in range(n) for j in range(n))
    whole = f"(SELECT *, {unit} FROM (SELECT {by}, {', '.join(f'sum(w * {features[i]} * {features[j]}) AS a{i}_{j}' for i in range(n) for j in range(n))} FROM {rows('best')} GROUP BY {by}))"
    return f"""newton AS (
  SELECT 0 AS step, {by}, {', '.join(f'0.0::DOUBLE AS {x}' for x in b)} FROM (SELECT DISTINCT {by} FROM {sample})
  UNION ALL
  SELECT step + 1, {by}, {', '.join(f'b{i} + a{i}_{n}' for i in range(n))} FROM {solved} WHERE step < {STEPS}
), best AS (SELECT {by}, {', '.join(b)} FROM newton WHERE step = {STEPS}),
inverse AS (SELECT {by}, {', '.join(f'a{i}_{n + i}' for i in range(n))} FROM {eliminated(whole, n, 2 * n, by)}),
fine AS (
  SELECT {by} FROM (SELECT {by}, count(*) AS rows, sum(-2 * ln(greatest(CASE WHEN {label} = 1 THEN p ELSE 1 - p END, 1e-300))) AS deviance FROM {rows('best')} GROUP BY {by})
  WHERE isfinite(deviance) AND deviance >= 1e-6 * rows
)"""


def terms_by(features: list[str], z95: float, by: str = "symbol") -> str:
    """The table of terms of each symbol."""
    n = len(features)
    terms = " UNION ALL ".join(f"SELECT {by}, '{x}' AS term, b{i} AS coef, sqrt(a{i}_{n + i}) AS std_err FROM best JOIN inverse USING ({by}) JOIN fine USING ({by})" for i, x in enumerate(features))
    return f"""SELECT {by}, term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(z, 6) AS z, round({TAIL}, 6) AS p_value,
  round(coef - {z95!r} * std_err, 6) AS ci_low, round(coef + {z95!r} * std_err, 6) AS ci_high FROM (SELECT *, coef / std_err AS z FROM ({terms}))"""


#: Twice the upper tail of a Gaussian beyond |z|, by the series of its lower half.
TAIL = """greatest(0, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 600),
  lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))))"""


def coefficient_table(features: list[str], z95: float) -> str:
    """The table of terms, from newton's last step and inverse."""
    n = len(features)
    terms = " UNION ALL ".join(f"SELECT '{x}' AS term, b{i} AS coef, sqrt(a{i}_{n + i}) AS std_err FROM best, inverse" for i, x in enumerate(features))
    return f"""SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(z, 6) AS z, round({TAIL}, 6) AS p_value,
  round(coef - {z95!r} * std_err, 6) AS ci_low, round(coef + {z95!r} * std_err, 6) AS ci_high FROM (SELECT *, coef / std_err AS z FROM ({terms}))"""
