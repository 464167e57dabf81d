"""Cleaning and scaling. ``fit_*`` returns a one-row relation of parameters,
which can be stored, and the transform reads it as a scalar subquery."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode import session
from corelode.functions.scalars import correlation
from corelode.operators.quantiles import any_of, modes, quantiles
from corelode.operators.validate import numeric_columns, text_columns


def with_row(df: DataFrame, one_row: DataFrame, name: str = "_p") -> DataFrame:
    """Attach a one-row relation to every row as a struct, without a join."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def fit_impute(df: DataFrame, strategy: str = "median", numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None) -> DataFrame:
    """Fill values: mean, median or mode for numbers, mode for texts."""
    numbers = numeric_columns(df) if numbers is None else list(numbers)
    texts = text_columns(df) if texts is None else list(texts)
    one = df.agg(F.count("*").alias("_fitted_rows"), *[F.avg(c).alias(c) for c in numbers if strategy == "mean"])
    if strategy == "median" and numbers:
        one = with_row(one, quantiles(df, [], {c: (F.col(c), 0.5) for c in numbers})).select("_fitted_rows", "_p.*")
    elif strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown strategy {strategy}")
    by_mode = [*texts, *(numbers if strategy == "mode" else [])]
    if by_mode:
        types = dict(df.dtypes)
        found = _modes_wide(df, by_mode, types)
        one = with_row(one, found).select("*", "_p.*").drop("_p")
    return one


def _modes_wide(df: DataFrame, columns: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Modes in one row, each in its column's own type (ties: the smallest)."""
    numbers = [c for c in columns if types[c] != "string"]
    texts = [c for c in columns if types[c] == "string"]
    parts = []
    if texts:
        parts.append(modes(df, texts).agg(*[F.max(F.when(F.col("field") == c, F.col("most_common"))).alias(c) for c in texts]))
    if numbers:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in numbers]))
        counted = df.select(cells.alias("_c")).select("_c.field", "_c.v").filter(F.col("v").isNotNull()).groupBy("field", "v").agg(F.count("*").alias("n"))
        best = counted.groupBy("field").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        parts.append(best.agg(*[F.max(F.when(F.col("field") == c, F.col("v"))).alias(c) for c in numbers]))
    one = parts[0]
    for p in parts[1:]:
        one = with_row(one, p).select("*", "_p.*").drop("_p")
    return one


def impute(df: DataFrame, fitted: DataFrame) -> DataFrame:
    filled = with_row(df, fitted)
    types = dict(df.dtypes)
    changes = {c: F.coalesce(F.col(c), F.col(f"_p.{c}").cast(types[c])) for c in fitted.columns if c in df.columns}
    return filled.withColumns(changes).drop("_p")


def fit_iqr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_lower`` and ``_upper``: quartiles widened by 1.5 times their distance."""
    wanted = {f"{c}_{n}": (F.col(c), p) for c in columns for n, p in (("q1", 0.25), ("q3", 0.75))}
    marks = quantiles(df, [], wanted)
    bounds = []
    for c in columns:
        low, high = F.col(f"{c}_q1"), F.col(f"{c}_q3")
        bounds += [(low - 1.5 * (high - low)).alias(f"{c}_lower"), (high + 1.5 * (high - low)).alias(f"{c}_upper")]
    return marks.select(*bounds)


def flag_iqr(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_outlier`` flags."""
    return with_row(df, bounds).withColumns({
        f"{c}_outlier": any_of([F.col(c) < F.col(f"_p.{c}_lower"), F.col(c) > F.col(f"_p.{c}_upper")]) for c in columns}).drop("_p")


def cap_outliers(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values clipped to the bounds; nulls stay null."""
    return with_row(df, bounds).withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_p.{c}_lower")), F.col(f"_p.{c}_upper"))) for c in columns}).drop("_p")


def remove_outliers(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no flagged column."""
    flagged = flag_iqr(df, bounds, columns)
    return flagged.filter(~any_of([F.col(f"{c}_outlier") for c in columns])).select(*df.columns)


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """``z_score`` (population deviation) and flag."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    z = F.try_divide(F.abs(F.col(column) - F.col("_p.m")), F.col("_p.s"))
    return with_row(df, stats).withColumn("z_score", z).withColumn("is_outlier", any_of([F.col("z_score") > threshold])).drop("_p")


def outliers_modified_z(df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
    """Score by the median absolute deviation; null where that is zero."""
    middle = quantiles(df, [], {"median": (F.col(column), 0.5)})
    away = with_row(df, middle).withColumn("_away", F.col(column) - F.col("_p.median")).drop("_p")
    mad = quantiles(away, [], {"mad": (F.abs("_away"), 0.5)})
    score = F.try_divide(F.lit(0.6745) * F.col("_away"), F.col("_p.mad"))
    return with_row(away, mad).withColumn("modified_z", score).withColumn(
        "is_outlier", any_of([F.abs("modified_z") > threshold])).drop("_p", "_away")


def transform_skew(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``_log`` where all values are positive and ``_sqrt`` where none is negative."""
    columns = numeric_columns(df) if columns is None else list(columns)
    ends = df.agg(*[F.min(c).alias(c) for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in columns]).first()
    added = {}
    for c in columns:
        # a missing value satisfies neither condition
        if ends[c] is None or ends[f"{c}__nulls"]:
            continue
        if ends[c] > 0:
            added[f"{c}_log"] = F.log1p(c)
        if ends[c] >= 0:
            added[f"{c}_sqrt"] = F.sqrt(c)
    return df.withColumns(added) if added else df


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """``<column>_shift`` and ``_width`` per column; a zero width becomes one."""
    if method == "robust":
        wanted = {f"{c}_{n}": (F.col(c), p) for c in columns for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
        marks = quantiles(df, [], wanted)
        pairs = {c: (F.col(f"{c}_q2"), F.col(f"{c}_q3") - F.col(f"{c}_q1")) for c in columns}
    elif method in ("standard", "minmax"):
        marks = df.agg(*[a for c in columns for a in (
            (F.avg(c).alias(f"{c}_a"), F.stddev_pop(c).alias(f"{c}_b")) if method == "standard"
            else (F.min(c).cast("double").alias(f"{c}_a"), (F.max(c) - F.min(c)).cast("double").alias(f"{c}_b")))])
        pairs = {c: (F.col(f"{c}_a"), F.col(f"{c}_b")) for c in columns}
    else:
        raise ValueError(f"unknown method {method}")
    return marks.select(*[x for c, (shift, width) in pairs.items() for x in (
        shift.alias(f"{c}_shift"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias(f"{c}_width"))])


def scale(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_row(df, fitted).withColumns({
        c: (F.col(c) - F.col(f"_p.{c}_shift")) / F.col(f"_p.{c}_width") for c in columns}).drop("_p")


def unscale(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_row(df, fitted).withColumns({
        c: F.col(c) * F.col(f"_p.{c}_width") + F.col(f"_p.{c}_shift") for c in columns}).drop("_p")


def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return df.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict() if columns else {}


def drop_low_variance(df: DataFrame, threshold: float = 0.01, keep: Sequence[str] = ()) -> DataFrame:
    found = variances(df, [c for c in numeric_columns(df) if c not in keep])
    return df.drop(*[c for c, v in found.items() if v is not None and v < threshold])


def _correlation_aggregates(columns: Sequence[str]) -> list[Column]:
    return [correlation(F.col(a), F.col(b)).alias(f"{i}_{j}") for (i, a), (j, b) in combinations(enumerate(columns), 2)]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (a, b, r) for every pair of columns, from one aggregation."""
    columns = numeric_columns(df) if columns is None else list(columns)
    one = df.agg(*_correlation_aggregates(columns), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            r = F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return one.select(F.inline(F.array(*rows)))


def drop_correlated(df: DataFrame, threshold: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    """Drops the less varying column of every pair correlated at the threshold
    or above (the second one when they vary alike)."""
    columns = [c for c in numeric_columns(df) if c not in keep]
    if len(columns) < 2:
        return df
    row = df.agg(*_correlation_aggregates(columns), *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    gone = set()
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        r = row[f"{i}_{j}"]
        if r is not None and abs(r) >= threshold:
            gone.add(a if (row[f"v{i}"] or 0) < (row[f"v{j}"] or 0) else b)
    return df.drop(*sorted(gone))


def preprocess(df: DataFrame, columns: Sequence[str], strategy: str = "median", method: str = "standard", keep: Sequence[str] = ()) -> DataFrame:
    """Impute, cap, drop flat and repeated columns, scale.

    Each fitted row is written before the rows read it: every later pass repeats
    the steps before it, and would fit their parameters again.
    """
    columns = list(columns)
    filled = impute(df, session.keep(fit_impute(df, strategy, columns, [])))
    capped = cap_outliers(filled, session.keep(fit_iqr(filled, columns)), columns)
    thinned = drop_correlated(drop_low_variance(capped, keep=keep), keep=keep)
    left = [c for c in columns if c in thinned.columns]
    return scale(thinned, session.keep(fit_scale(thinned, left, method)), left) if left else thinned


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes 0, 1, 2 … of the distinct values in alphabetical order."""
    from corelode.operators.ordered import row_numbers

    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return row_numbers(values, [], [column], "_code").select(column, (F.col("_code") - 1).alias(f"{column.lower()}_encoded"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``<column>_encoded``; values without a code become -1.

    Codes found here are taken from the plain rows and written: Spark sees how few
    they are and takes them to the rows, where a common value would fill one task.
    """
    found = codes or {c: session.keep(label_codes(df, c)) for c in columns}
    for c in columns:
        name = f"{c.lower()}_encoded"
        df = df.join(found[c], c, "left").withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))
    return df


def category_codes(column: str, order: Sequence[str]) -> Column:
    """Position in a fixed order; other values are null."""
    code = F.lit(None).cast("long")
    for i, value in enumerate(order):
        code = F.when(F.col(column) == value, F.lit(i).cast("long")).otherwise(code)
    return code


def identity_hash(df: DataFrame, id_columns: Sequence[str], seed: int) -> Column:
    """A number from the row's identity, the same in every engine: 60 bits of the
    MD5 of seed and values, numbers in whole thousandths."""
    kinds = dict(df.dtypes)
    parts = [F.round(F.col(c) * 1000).cast("long").cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in id_columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def split(df: DataFrame, id_columns: Sequence[str], test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part`` (train, validation, test) from a hash of the row's identity.

    The part of a row does not depend on partitioning or on other rows. The
    validation share is taken of what the test part leaves.
    """
    at = identity_hash(df, id_columns, seed) % 10_000
    first, second = round(test * 10_000), round((test + (1 - test) * validation) * 10_000)
    return df.withColumn("part", F.when(at < first, "test").when(at < second, "validation").otherwise("train"))


def split_sizes(parted: DataFrame, key: str = "Element") -> DataFrame:
    return parted.groupBy(key).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "validation", "test")])


def split_stability(df: DataFrame, id_columns: Sequence[str], seed: int = 42, times: int = 3) -> DataFrame:
    """Test rows that differ between repeated splits of reshuffled input (none)."""
    first = split(df, id_columns, seed=seed).filter("part = 'test'").select(*id_columns)
    different = None
    for i in range(1, times):
        again = split(df.repartition(F.xxhash64(F.lit(i), *id_columns)), id_columns, seed=seed).filter("part = 'test'").select(*id_columns)
        found = first.exceptAll(again).unionByName(again.exceptAll(first))
        different = found if different is None else different.unionByName(found)
    return different.agg(F.count("*").alias("different_rows")).withColumn("stable", F.col("different_rows") == 0)
