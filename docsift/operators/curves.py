"""Threshold-curve jobs: score candidate curves against anchor points (A10)
and fit the log-quadratic curve by least squares (A11).

Both are single aggregations over an anchor table (size, expected); the
candidate curves are columns, unpivoted, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.threshold import DEFAULT_CURVE, ThresholdCurve

# ---------------------------------------------------------------------------
# The rejected candidate curves and their parameters.
# ---------------------------------------------------------------------------
SQRT_K = 0.707
LOG_A, LOG_B = 8.34, -27.6
POWER_A, POWER_P = 0.539, 0.569
CAP_MIN, CAP_PCT = 1.0, 0.10
CURVE_NAMES = ["sqrt", "log", "power", "sqrt_capped", "power_capped", "log_quadratic"]
# ---------------------------------------------------------------------------


def candidate_values(size: Column, curve: ThresholdCurve = DEFAULT_CURVE) -> dict[str, Column]:
    s = size.cast("double")
    sqrt = F.lit(SQRT_K) * F.sqrt(s)
    power = F.lit(POWER_A) * F.pow(s, F.lit(POWER_P))
    log = F.when(s <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(LOG_A) * F.log(s) + F.lit(LOG_B)))
    ln = F.log(s)
    return {
        "sqrt": sqrt,
        "log": log,
        "power": power,
        "sqrt_capped": F.greatest(F.lit(CAP_MIN), F.least(sqrt, s * CAP_PCT)),
        "power_capped": F.greatest(F.lit(CAP_MIN), F.least(power, s * CAP_PCT)),
        "log_quadratic": F.lit(curve.a) * ln * ln + F.lit(curve.b) * ln + F.lit(curve.c),
    }


def score_curves(anchors: DataFrame, curve: ThresholdCurve = DEFAULT_CURVE) -> DataFrame:
    """A10: average |actual - expected| / expected * 100 per candidate curve,
    ranked best first. ``anchors``: size, expected (> 0)."""
    vals = candidate_values(F.col("size"), curve)
    stacked = anchors.select(
        "expected",
        F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), v.alias("actual")) for n, v in vals.items()]))
        .alias("c"))
    err = F.abs(F.col("c.actual") - F.col("expected")) / F.col("expected") * 100
    scored = stacked.groupBy(F.col("c.curve").alias("curve")).agg(
        F.round(F.avg(err), 4).alias("avg_error_pct"),
        F.round(F.max(err), 4).alias("max_error_pct"),
        F.count(F.lit(1)).alias("anchors"))
    # one row per candidate curve: a global rank over six rows
    return scored.withColumn("rank", F.rank().over(Window.orderBy("avg_error_pct")))


def fit_log_quadratic(points: DataFrame, group_cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Least-squares a, b, c of y = a*ln(x)^2 + b*ln(x) + c per group,
    from one pass of power sums and the closed-form 3x3 solve."""
    group_cols = group_cols or []
    x = F.log(F.col("size").cast("double"))
    y = F.col("expected").cast("double")
    g = points.filter(F.col("size") > 0).groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"),
        F.sum(x * x * x * x).alias("s4"), F.sum(y).alias("t0"), F.sum(x * y).alias("t1"),
        F.sum(x * x * y).alias("t2"))
    c = {k: F.col(k) for k in ["n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"]}

    def det3(m):
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    m = [[c["s4"], c["s3"], c["s2"]], [c["s3"], c["s2"], c["s1"]], [c["s2"], c["s1"], c["n"]]]
    rhs = [c["t2"], c["t1"], c["t0"]]
    d = det3(m)

    def col_replaced(j):
        return [[rhs[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]

    return g.select(
        *group_cols,
        F.col("n").cast("long").alias("points"),
        F.round(det3(col_replaced(0)) / d, digits).alias("a"),
        F.round(det3(col_replaced(1)) / d, digits).alias("b"),
        F.round(det3(col_replaced(2)) / d, digits).alias("c"),
    )
