"""Analytics on results: trends, comparisons, shares of area, record histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trend(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares line and the standard error of its slope."""
    g = df.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_count(y, x).alias("n")
    )
    rest = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    return g.select(key, "slope", "intercept", F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (F.col("n") - 2) * F.col("sxx"))).alias("slope_se"))


def share_above(df: DataFrame, metric: str, limit: float) -> DataFrame:
    """Percent of area above a limit, per period."""
    return df.groupBy("p").agg((F.coalesce(F.sum(F.when(F.col(metric) > limit, F.col("a"))), F.lit(0.0)) / F.sum("a") * 100).alias("percent"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], absolute: float = 5e-5, relative: float | None = None) -> DataFrame:
    """Largest difference of each metric, values that one table lacks, and whether all is within the tolerance.

    With ``relative`` differences are shares of the second table's values, and where that is 0
    or missing they are 0.  A key that one table lacks is a value it lacks for every metric
    that the other has there.
    """
    x = a.alias("a").join(b.alias("b"), keys, "full")
    one, two = (lambda m, t=t: F.col(f"{t}.{m}") for t in "ab")
    share = lambda m: F.coalesce(F.try_divide(one(m) - two(m), two(m)), F.when(two(m) == 0, F.lit(0.0)))
    gap = lambda m: F.abs(one(m) - two(m)) if relative is None else F.abs(share(m))
    found = [F.struct(F.max(gap(m)).alias("gap"), F.count_if(one(m).isNull() != two(m).isNull()).alias("one_sided")).alias(m) for m in metrics]
    long = x.agg(*found).select(F.stack(F.lit(len(metrics)), *[y for m in metrics for y in (F.lit(m), F.col(m))]).alias("metric", "r"))
    out = long.select("metric", "r.gap", "r.one_sided")
    return out.withColumn("within", (F.coalesce(F.col("gap"), F.lit(0.0)) <= (absolute if relative is None else relative)) & (F.col("one_sided") == 0))


def at_point(cells: DataFrame, y: float, x: float) -> DataFrame:
    """The row of the cell nearest a point, by coordinate differences; of equal ones the least id."""
    far = F.abs(F.col("y") - y) + F.abs(F.col("x") - x)
    return cells.filter("y is not null and x is not null").orderBy(F.round(far, 9), "cell_id").limit(1)


def trend_bounds(df: DataFrame, key: str, x: str, y: str, z: float = 1.645) -> DataFrame:
    """:func:`trend` with the slope's bounds at ``z`` standard errors."""
    t = trend(df, key, x, y)
    return t.withColumn("slope_low", F.col("slope") - z * F.col("slope_se")).withColumn("slope_high", F.col("slope") + z * F.col("slope_se"))


def trend_ratio(df: DataFrame, key: str, x: str, y: str, base: str) -> DataFrame:
    """Slope of each key over that of the key ``base``, whose own row has the ratio 1."""
    t = trend(df, key, x, y)
    own = t.filter(F.col(key) == F.lit(base)).agg(F.max("slope").alias("_own"))
    return t.crossJoin(F.broadcast(own)).select(key, F.try_divide("slope", "_own").alias("ratio"))  # one row beside every key


def factor_spans(factors: DataFrame, key: str, metric: str, spans: list[tuple[str, str, str]], dof: float | DataFrame = 1.0) -> DataFrame:
    """Geometric mean of a factor in each named span, and the mean's spread for ``dof`` independent regions.

    ``dof`` is a number or one row with ``n_dof``.
    """
    value = F.when(F.col(metric) > 0, F.col(metric))
    inside = lambda a, b: F.when(F.col("p").between(F.lit(a).cast("date"), F.lit(b).cast("date")), value)
    per = [F.struct(F.exp(F.avg(F.ln(inside(a, b)))).alias("m"), F.stddev_pop(inside(a, b)).alias("s")).alias(n) for n, a, b in spans]
    long = factors.groupBy(key).agg(*per)
    pairs = [y for n, _, _ in spans for y in (F.lit(n), F.col(n))]
    long = long.select(key, F.stack(F.lit(len(spans)), *pairs).alias("span", "r"))
    if isinstance(dof, DataFrame):
        long, n = long.crossJoin(F.broadcast(dof.select("n_dof"))), F.col("n_dof")  # one row beside every span
    else:
        n = F.lit(dof)
    return long.select(key, "span", F.col("r.m").alias("factor"), (F.col("r.s") / F.sqrt(n)).alias("spread"))


def mean_of_rows(df: DataFrame, key: str, metric: str, first: int, last: int) -> DataFrame:
    """Arithmetic mean over rows ``first`` to ``last - 1`` of each series, from 0; negative rows count from its end."""
    w = Window.partitionBy(key)
    n, size = F.row_number().over(w.orderBy("p")) - 1, F.count("*").over(w)
    at = lambda k: size + k if k < 0 else F.lit(k)
    inside = df.withColumn("_n", n).withColumn("_a", at(first)).withColumn("_b", at(last)).filter("_n >= _a and _n < _b")
    return inside.groupBy(key).agg(F.avg(metric).alias(metric))


def decade_pairs(a: DataFrame, b: DataFrame, keys: list[str], q: float = 0.9) -> DataFrame:
    """Values of ``b`` on the days when ``a`` is at or above its quantile, averaged with ``a`` by decade."""
    key, day = keys
    top = a.groupBy(key).agg(F.percentile("v", F.lit(q)).alias("t"))
    hot = a.join(top, key).filter("v >= t").select(*keys, F.col("v").alias("a"))
    met = hot.join(b.select(*keys, F.col("v").alias("b")), keys)
    return met.groupBy(key, (F.floor(F.year(day) / 10) * 10).cast("int").alias("decade")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("n"))


def start_years(series: DataFrame) -> DataFrame:
    """How many stations begin in each year."""
    return series.groupBy("cell_id").agg(F.min(F.when(F.col("v").isNotNull(), F.year("d"))).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def bands(df: DataFrame, metric: str, sigma: str) -> DataFrame:
    """Confidence bands of one and 1.645 standard deviations about a factor of one."""
    return df.select("*", *[(F.lit(1.0) + k * F.col(sigma)).alias(n) for n, k in (("low90", -1.645), ("low", -1.0), ("high", 1.0), ("high90", 1.645))])


def log_product(a, b):
    """Product of positive values; missing where one is not."""
    return F.when((a > 0) & (b > 0), F.pow(F.lit(10.0), F.log10(F.when(a > 0, a)) + F.log10(F.when(b > 0, b))))


def box_mean(cells: DataFrame, y0: float, y1: float, x0: float, x1: float, metric: str) -> DataFrame:
    return cells.filter(F.col("y").between(y0, y1) & F.col("x").between(x0, x1)).agg(F.avg(metric).alias(metric))
