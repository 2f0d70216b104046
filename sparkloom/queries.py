"""Registered queries over the standard tables, with DuckDB SQL for the same rows.

Results are rounded where sums may differ in their last bits, and -0.0 is made 0.0, in both.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_LOW
from .operators import cluster, compose, decomposition, encoders, imputers, linear, matrix, metrics, profile, report, scalers, selection, splits, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return t(spark, d, "lineitem").select(*KEY, *LI, *more)


def rounded(df: DataFrame, cols: list[str] | None = None, n: int = 6) -> DataFrame:
    """df with these columns (all doubles) rounded, -0.0 as 0.0."""
    cols = cols if cols is not None else [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), n) + F.lit(0.0) for c in cols})


def rnd(x: str, name: str, n: int = 6) -> str:
    return f'round({x}, {n}) + 0.0 AS "{name}"'


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def inv_normal_sql(p: str) -> str:
    def poly(cs: tuple[float, ...], x: str) -> str:
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out

    tail = lambda q: f"{poly(ACKLAM_C, q)} / {poly((*ACKLAM_D, 1.0), q)}"
    low, high, r = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < {ACKLAM_LOW} THEN {tail(low)} WHEN {p} <= {1 - ACKLAM_LOW} THEN {poly(ACKLAM_A, r)} * ({p} - 0.5) / {poly((*ACKLAM_B, 1.0), r)} ELSE -({tail(high)}) END"


# Statistics


@query("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, {rnd(f'sum({c})', 'sum', 2)}, {rnd(f'avg({c})', 'mean')}, {rnd(f'min({c})', 'min')}, {rnd(f'max({c})', 'max')}, {rnd(f'var_samp({c})', 'var', 4)}, {rnd(f'stddev_samp({c})', 'std')} FROM lineitem" for c in LI))
def column_stats(spark, d):
    got = stats.column_stats(lineitem(spark, d), LI)
    return rounded(rounded(rounded(got, ["sum"], 2), ["var"], 4), ["mean", "min", "max", "std"])


@query("quantiles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q!r}::DOUBLE AS q, {rnd(f'quantile_cont({c}, {q})', 'value')} FROM lineitem" for c in LI for q in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)))
def quantiles(spark, d):
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = stats.quantiles(lineitem(spark, d), LI, qs)
    return rounded(rows_of(spark, [(c, q, v) for c in LI for q, v in zip(qs, got[c], strict=True)], "column string, q double, value double"), ["value"])


@query("mode_ties", "SELECT l_quantity::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def mode_ties(spark, d):
    return stats.mode(lineitem(spark, d), "l_quantity")


def _matrix_rows(spark, m: np.ndarray, names: list[str], n: int) -> DataFrame:
    return rounded(rows_of(spark, [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, value double"), ["value"], n)


@query("cov_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'covar_samp({a}, {b})', 'value', 4)} FROM lineitem" for a in LI for b in LI))
def cov_matrix(spark, d):
    return _matrix_rows(spark, stats.covariance(lineitem(spark, d), LI), LI, 4)


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'any_value(1.0)' if a == b else f'corr({a}, {b})', 'value')} FROM lineitem" for a in LI for b in LI))
def corr_matrix(spark, d):
    return _matrix_rows(spark, stats.correlation(lineitem(spark, d), LI), LI, 6)


@query("contingency", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark, d):
    return stats.contingency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("duplicates", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_discount, l_tax, l_returnflag FROM lineitem)) AS duplicates FROM lineitem")
def duplicates(spark, d):
    return stats.duplicate_rows(t(spark, d, "lineitem"), ["l_discount", "l_tax"], ["l_returnflag"])


@query("distinct_count", "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations FROM customer")
def distinct_count(spark, d):
    return t(spark, d, "customer").agg(F.countDistinct("c_mktsegment").alias("segments"), F.countDistinct("c_nationkey").alias("nations"))


@query("finiteness", "SELECT 'value' AS \"column\", sum((event_id % 7 = 0)::INT)::BIGINT AS bad FROM events")
def finiteness(spark, d):
    bad = selection.non_finite(holed(spark, d), ["value"])
    return rows_of(spark, list(bad.items()), "column string, bad bigint")


# Scalers


def _scaled(make, sql_of: Callable[[str], str], aggregates: Callable[[str], list[str]], name: str, cols=LI):
    """Register a scaler with its SQL: aggregates by column, then an expression of them."""
    aggs = ", ".join(f"{a} AS {c}_a{i}" for c in cols for i, a in enumerate(aggregates(c)))
    sql = f"WITH s AS (SELECT {aggs} FROM lineitem) SELECT {KEYS}, {', '.join(rnd(sql_of(c), c) for c in cols)} FROM lineitem, s"
    QUERIES[name] = lambda spark, d: rounded(make().fit_transform(lineitem(spark, d), cols), cols)
    ORACLES[name] = sql


_scaled(scalers.StandardScaler, lambda c: f"({c} - {c}_a0) / {c}_a1", lambda c: [f"avg({c})", f"stddev_pop({c})"], "standard_scaler")
_scaled(partial(scalers.StandardScaler, with_std=False), lambda c: f"{c} - {c}_a0", lambda c: [f"avg({c})"], "standard_scaler_mean_only")
_scaled(scalers.MinMaxScaler, lambda c: f"({c} - {c}_a0) / ({c}_a1 - {c}_a0)", lambda c: [f"min({c})", f"max({c})"], "minmax_scaler")
_scaled(partial(scalers.MinMaxScaler, -1.0, 3.0), lambda c: f"-1.0 + ({c} - {c}_a0) * 4.0 / ({c}_a1 - {c}_a0)", lambda c: [f"min({c})", f"max({c})"], "minmax_scaler_range")
_scaled(scalers.MaxAbsScaler, lambda c: f"{c} / {c}_a0", lambda c: [f"max(abs({c}))"], "maxabs_scaler")
_scaled(scalers.RobustScaler, lambda c: f"({c} - {c}_a1) / ({c}_a2 - {c}_a0)", lambda c: [f"quantile_cont({c}, {q})" for q in (0.25, 0.5, 0.75)], "robust_scaler")
_scaled(partial(scalers.Binarizer, 0.05), lambda c: f"CASE WHEN {c} > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", lambda c: ["any_value(1)"], "binarizer")
_scaled(partial(scalers.Normalizer, "l1"), lambda c: f"{c} / ({' + '.join(f'abs({x})' for x in LI)})", lambda c: ["any_value(1)"], "normalizer_l1")
_scaled(partial(scalers.Normalizer, "l2"), lambda c: f"{c} / sqrt({' + '.join(f'{x} * {x}' for x in LI)})", lambda c: ["any_value(1)"], "normalizer_l2")
_scaled(partial(scalers.Normalizer, "max"), lambda c: f"{c} / greatest({', '.join(f'abs({x})' for x in LI)})", lambda c: ["any_value(1)"], "normalizer_max")


@query("scaler_inverse", f"SELECT {KEYS}, {', '.join(rnd(c, c) for c in LI)} FROM lineitem")
def scaler_inverse(spark, d):
    df = lineitem(spark, d)
    for e in (scalers.StandardScaler(), scalers.MinMaxScaler(-1, 1), scalers.MaxAbsScaler(), scalers.RobustScaler()):
        m = e.fit(df, LI)
        df = m.inverse_transform(m.transform(df))
    return rounded(df, LI)


@query("standard_scaler_constant", "SELECT c_custkey, 0.0::DOUBLE AS k FROM customer")
def standard_scaler_constant(spark, d):
    df = t(spark, d, "customer").select("c_custkey", F.lit(4.5).alias("k"))
    return rounded(scalers.StandardScaler().fit_transform(df, ["k"]))


def _bins_sql(c: str, edges: list[str], onehot: bool) -> str:
    n = len(edges) - 1
    count = " + ".join(f"({c} >= {e})::INT" for e in edges[1:-1])
    return f"CASE WHEN {c} >= {edges[-1]} THEN {n - 1} WHEN {c} <= {edges[0]} THEN 0 ELSE {count} END"


@query("kbins_uniform", f"WITH s AS (SELECT min(l_extendedprice) lo, (max(l_extendedprice) - min(l_extendedprice)) / 5.0 w, max(l_extendedprice) hi FROM lineitem) SELECT {KEYS}, ({_bins_sql('l_extendedprice', [f'(lo + w * {i}.0)' for i in range(6)], False)})::DOUBLE AS l_extendedprice FROM lineitem, s")
def kbins_uniform(spark, d):
    return scalers.KBinsDiscretizer(5, "uniform").fit_transform(lineitem(spark, d).select(*KEY, "l_extendedprice"), ["l_extendedprice"])


_KQ = ", ".join(f"quantile_cont(l_quantity, {i / 4}) q{i}" for i in range(5))


@query("kbins_quantile", f"WITH s AS (SELECT {_KQ} FROM lineitem) SELECT {KEYS}, ({_bins_sql('l_quantity', [f'q{i}' for i in range(5)], False)})::DOUBLE AS l_quantity FROM lineitem, s")
def kbins_quantile(spark, d):
    return scalers.KBinsDiscretizer(4, "quantile").fit_transform(lineitem(spark, d).select(*KEY, "l_quantity"), ["l_quantity"])


@query("kbins_onehot", f"WITH s AS (SELECT {_KQ} FROM lineitem), b AS (SELECT *, {_bins_sql('l_quantity', [f'q{i}' for i in range(5)], False)} AS b FROM lineitem, s) SELECT {KEYS}, " + ", ".join(f"(b = {i})::INT::DOUBLE AS l_quantity_bin{i}" for i in range(4)) + " FROM b")
def kbins_onehot(spark, d):
    return scalers.KBinsDiscretizer(4, "quantile", "onehot").fit_transform(lineitem(spark, d).select(*KEY, "l_quantity"), ["l_quantity"])


_LLOYD = """WITH RECURSIVE s AS (SELECT list_distinct([min(value), quantile_cont(value, 1 / 3), quantile_cont(value, 2 / 3), max(value)]) AS c, min(value) lo, max(value) hi FROM events),
  k AS (SELECT 0 AS i, list_sort(c) AS c, false AS still FROM s UNION ALL SELECT i + 1, list(m ORDER BY g), bool_and(abs(m - c[g]) <= 1e-12) FROM (
    SELECT i, any_value(c) c, g, avg(value) m FROM (SELECT i, c, value, list_position(list_transform(c, lambda x: abs(value - x)), list_min(list_transform(c, lambda x: abs(value - x)))) g FROM k, events WHERE i < 50 AND NOT still) GROUP BY i, g) GROUP BY i),
  e AS (SELECT list_sort(c) c FROM k ORDER BY i DESC LIMIT 1)"""


@query("kbins_kmeans", f"{_LLOYD} SELECT event_id, (CASE WHEN value >= hi THEN len(e.c) - 1 WHEN value <= lo THEN 0 ELSE len(list_filter(range(1, len(e.c)), lambda j: value >= (e.c[j] + e.c[j + 1]) / 2)) END)::DOUBLE AS value FROM events, e, s")
def kbins_kmeans(spark, d):
    return scalers.KBinsDiscretizer(4, "kmeans").fit_transform(t(spark, d, "events").select("event_id", "value"), ["value"])


def _percentile_sql(c: str, n: int) -> str:
    p = "0.0"
    for i in range(n - 1):
        p = f"CASE WHEN {c} >= r{i} AND {c} < r{i + 1} THEN ({i} + ({c} - r{i}) / (r{i + 1} - r{i})) / {n - 1}.0 ELSE {p} END"
    return f"CASE WHEN {c} <= r0 THEN 0.0 WHEN {c} >= r{n - 1} THEN 1.0 ELSE {p} END"


def _refs(c: str, table: str, n: int) -> str:
    return f"SELECT {', '.join(f'quantile_cont({c}, {i / (n - 1)!r}) r{i}' for i in range(n))} FROM {table}"


@query("quantile_transformer", f"WITH s AS ({_refs('value', 'events', 11)}) SELECT event_id, {rnd(_percentile_sql('value', 11), 'value')} FROM events, s")
def quantile_transformer(spark, d):
    return rounded(scalers.QuantileTransformer(11).fit_transform(t(spark, d, "events").select("event_id", "value"), ["value"]))


@query("quantile_transformer_normal", f"WITH s AS ({_refs('o_totalprice', 'orders', 11)}), p AS (SELECT o_orderkey, least(greatest({_percentile_sql('o_totalprice', 11)}, 1e-9), 1 - 1e-9)::DOUBLE AS p FROM orders, s) SELECT o_orderkey, {rnd(inv_normal_sql('p'), 'o_totalprice', 5)} FROM p")
def quantile_transformer_normal(spark, d):
    return rounded(scalers.QuantileTransformer(11, "normal").fit_transform(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), n=5)


@query("power_fixed", f"WITH x AS (SELECT event_id, (pow(value, 0.3) - 1) / 0.3 AS b, CASE WHEN value - 50 >= 0 THEN (pow(value - 49, 0.7) - 1) / 0.7 ELSE -(pow(51 - value, 1.3) - 1) / 1.3 END AS y FROM events), s AS (SELECT avg(b) mb, stddev_pop(b) sb, avg(y) my, stddev_pop(y) sy FROM x) SELECT event_id, {rnd('(b - mb) / sb', 'b')}, {rnd('(y - my) / sy', 'y')} FROM x, s")
def power_fixed(spark, d):
    df = t(spark, d, "events").select("event_id", F.col("value").alias("b"), (F.col("value") - 50).alias("y"))
    for c, lam, method in (("b", 0.3, "box-cox"), ("y", 0.7, "yeo-johnson")):
        raw = scalers.PowerModel([c], [lam], [0.0], [1.0], method, False, zero=True).transform(df)
        df = scalers.StandardScaler().fit_transform(raw, [c])
    return rounded(df)


def _likelihood(levels: int, value: str) -> str:
    """SQL of the most likely Box-Cox lambda: a grid of tenths, then finer ones around the best."""
    ctes = [f"x AS (SELECT {value} AS v FROM events)", "j AS (SELECT sum(ln(v)) AS j, count(*) AS n FROM x)", "l0 AS (SELECT 0.0::DOUBLE AS lam)"]
    for i in range(1, levels + 1):
        reach, step = (50, 0.1) if i == 1 else (12, 10.0**-i)
        power = "CASE WHEN abs(g) < 1e-8 THEN ln(v) ELSE (pow(v, g) - 1) / g END"
        ctes.append(f"g{i} AS (SELECT lam + k * {step!r}::DOUBLE AS g FROM l{i - 1}, range(-{reach}, {reach + 1}) r(k))")
        ctes.append(f"l{i} AS (SELECT g AS lam FROM (SELECT g, ln(var_pop({power})) AS lv FROM g{i}, x GROUP BY g), j ORDER BY n / 2 * lv - (g - 1) * j, g LIMIT 1)")
    return "WITH " + ", ".join(ctes)


@query("power_fitted")
def power_fitted(spark, d):
    df = t(spark, d, "events").select("event_id", (F.col("value") + 1).alias("value"))
    return rounded(scalers.PowerTransformer("box-cox").fit_transform(df, ["value"]), n=4)


@query("power_parameters", f"{_likelihood(6, 'value + 1')}, y AS (SELECT lam, (pow(v, lam) - 1) / lam AS y FROM x, l6) SELECT 'value' AS \"column\", {rnd('any_value(lam)', 'lambda', 3)}, {rnd('avg(y)', 'mean', 1)}, {rnd('stddev_pop(y)', 'std', 1)} FROM y")
def power_parameters(spark, d):
    m = scalers.PowerTransformer("box-cox").fit(t(spark, d, "events").select((F.col("value") + 1).alias("value")), ["value"])
    return rounded(rounded(rows_of(spark, [("value", m.lambdas[0], m.mean[0], m.std[0])], "column string, lambda double, mean double, std double"), ["lambda"], 3), ["mean", "std"], 1)


@query("variance_threshold", f"SELECT {KEYS}, l_quantity, l_extendedprice FROM lineitem")
def variance_threshold(spark, d):
    return selection.VarianceThreshold(0.01).fit_transform(lineitem(spark, d), LI)


_POLY = [t_ for k in (1, 2) for t_ in itertools.combinations_with_replacement(LI[:3], k)]


def _product_name(p: tuple[str, ...]) -> str:
    return f"{p[0]}^2" if len(p) == 2 and p[0] == p[1] else " ".join(p)


@query("polynomial", f"SELECT {KEYS}, 1.0::DOUBLE AS \"1\", " + ", ".join(rnd(" * ".join(p), _product_name(p), 4) for p in _POLY) + " FROM lineitem")
def polynomial(spark, d):
    return rounded(scalers.PolynomialFeatures(2).fit_transform(lineitem(spark, d).select(*KEY, *LI[:3]), LI[:3]), n=4)


@query("polynomial_interactions", f"SELECT {KEYS}, " + ", ".join(rnd(" * ".join(p), " ".join(p), 4) for k in (1, 2, 3) for p in itertools.combinations(LI[:3], k)) + " FROM lineitem")
def polynomial_interactions(spark, d):
    return rounded(scalers.PolynomialFeatures(3, True, False).fit_transform(lineitem(spark, d).select(*KEY, *LI[:3]), LI[:3]), n=4)


@query("function_transformer", f"SELECT {KEYS}, {rnd('ln(l_extendedprice + 1)', 'l_extendedprice')} FROM lineitem")
def function_transformer(spark, d):
    e = scalers.FunctionTransformer(lambda x: [F.log1p(v) for v in x], lambda x: [F.expm1(v) for v in x])
    return rounded(e.fit_transform(lineitem(spark, d).select(*KEY, "l_extendedprice"), ["l_extendedprice"]))


# Encoders

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def _coded(column: str, table: str, key: str) -> str:
    return f"WITH c AS (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS code FROM (SELECT DISTINCT {column} FROM {table})) SELECT {key}, code::DOUBLE AS {column} FROM {table} JOIN c USING ({column})"


@query("onehot", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT::DOUBLE AS \"o_orderstatus_{s}\"" for s in "FOP") + " FROM orders")
def onehot(spark, d):
    return encoders.OneHotEncoder().fit_transform(orders(spark, d).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("onehot_drop_first", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT::DOUBLE AS \"o_orderstatus_{s}\"" for s in "OP") + " FROM orders")
def onehot_drop_first(spark, d):
    return encoders.OneHotEncoder("first").fit_transform(orders(spark, d).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("onehot_ignore", "SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT::DOUBLE AS \"o_orderstatus_O\" FROM orders")
def onehot_ignore(spark, d):
    df = orders(spark, d).select("o_orderkey", "o_orderstatus")
    return encoders.OneHotEncoder(handle_unknown="ignore").fit(df.where("o_orderstatus != 'P'"), ["o_orderstatus"]).transform(df)


@query("onehot_sparse", "WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, 5 AS size, code::INT AS \"index\" FROM orders JOIN c USING (o_orderpriority)")
def onehot_sparse(spark, d):
    df = orders(spark, d)
    got = encoders.OneHotEncoder().fit(df, ["o_orderpriority"]).transform_sparse(df)
    return got.select("o_orderkey", "onehot.size", F.get("onehot.indices", F.lit(0)).alias("index"))


@query("onehot_inverse", "SELECT o_orderkey, o_orderstatus FROM orders")
def onehot_inverse(spark, d):
    df = orders(spark, d).select("o_orderkey", "o_orderstatus")
    m = encoders.OneHotEncoder("first").fit(df, ["o_orderstatus"])
    return m.inverse_transform(m.transform(df))


@query("ordinal", _coded("o_orderpriority", "orders", "o_orderkey"))
def ordinal(spark, d):
    return encoders.OrdinalEncoder().fit_transform(orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("ordinal_manual", "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0.0 WHEN '3-MEDIUM' THEN 1.0 WHEN '1-URGENT' THEN 2.0 ELSE -1.0 END::DOUBLE AS o_orderpriority FROM orders")
def ordinal_manual(spark, d):
    e = encoders.OrdinalEncoder([["5-LOW", "3-MEDIUM", "1-URGENT"]], "use_neg_one")
    return e.fit_transform(orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("label_encoder", "WITH c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, code AS c_mktsegment FROM customer JOIN c USING (c_mktsegment)")
def label_encoder(spark, d):
    return encoders.LabelEncoder().fit_transform(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("frequency", "SELECT o_orderkey, (count(*) OVER (PARTITION BY o_orderpriority))::DOUBLE AS o_orderpriority FROM orders")
def frequency(spark, d):
    return encoders.FrequencyEncoder().fit_transform(orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("frequency_normalized", f"SELECT o_orderkey, {rnd('count(*) OVER (PARTITION BY o_orderpriority) / (count(*) OVER ())', 'o_orderpriority')} FROM orders")
def frequency_normalized(spark, d):
    return rounded(encoders.FrequencyEncoder(True).fit_transform(orders(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"]))


@query("frequency_high_cardinality", "SELECT o_orderkey, (count(*) OVER (PARTITION BY o_custkey))::DOUBLE AS o_custkey FROM orders")
def frequency_high_cardinality(spark, d):
    return encoders.FrequencyEncoder().fit_transform(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("target_encoder", f"WITH g AS (SELECT avg(o_totalprice) m FROM orders), c AS (SELECT o_orderpriority, (sum(o_totalprice) + 10 * any_value(m)) / (count(*) + 10) AS e FROM orders, g GROUP BY 1) SELECT o_orderkey, o_totalprice, {rnd('e', 'o_orderpriority', 4)} FROM orders JOIN c USING (o_orderpriority)")
def target_encoder(spark, d):
    df = orders(spark, d).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(encoders.TargetEncoder(10.0).fit_transform(df, ["o_orderpriority"], "o_totalprice"), ["o_orderpriority"], 4)


# Imputers


def holed(spark, d) -> DataFrame:
    """events with every seventh value missing."""
    return t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


_HOLED = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def _imputer(name: str, strategy: str, fill: str) -> None:
    QUERIES[name] = lambda spark, d: rounded(imputers.SimpleImputer(strategy, -1.0).fit_transform(holed(spark, d), ["value"]))
    ORACLES[name] = f"WITH h AS {_HOLED}, s AS ({fill}) SELECT event_id, {rnd('coalesce(value, f)', 'value')} FROM h, s"


_imputer("imputer_mean", "mean", "SELECT avg(value) AS f FROM h")
_imputer("imputer_median", "median", "SELECT quantile_cont(value, 0.5) AS f FROM h")
_imputer("imputer_mode", "most_frequent", "SELECT value AS f FROM h WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1")
_imputer("imputer_constant", "constant", "SELECT -1.0 AS f")


def _knn(name: str, weights: str) -> None:
    def run(spark, d):
        c = t(spark, d, "customer")
        df = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("bal"), F.when((F.col("c_custkey") % 7 != 0) | (F.col("c_custkey") % 5 == 0), F.col("c_nationkey").cast("double")).alias("nation"))
        return rounded(imputers.KnnImputer(3, weights, "c_custkey").fit_transform(df, ["bal", "nation"]), n=5)

    w = "1.0" if weights == "uniform" else "1.0 / greatest(d, 1e-12)"
    QUERIES[name] = run
    ORACLES[name] = f"""WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 7 <> 0 OR c_custkey % 5 = 0 THEN c_nationkey::DOUBLE END AS nation FROM customer),
      p AS (SELECT a.c_custkey id, b.c_custkey ref, b.bal rb, b.nation rn, (a.bal IS NOT NULL AND b.bal IS NOT NULL)::INT + (a.nation IS NOT NULL AND b.nation IS NOT NULL)::INT AS k,
        coalesce(pow(a.bal - b.bal, 2), 0) + coalesce(pow(a.nation - b.nation, 2), 0) AS s FROM h a, h b WHERE a.bal IS NULL OR a.nation IS NULL),
      n AS (SELECT *, s * (2.0 / k) AS d, row_number() OVER (PARTITION BY id ORDER BY s * (2.0 / k), ref) AS r FROM p WHERE k > 0),
      f AS (SELECT id, sum(rb * ({w})) / sum(CASE WHEN rb IS NOT NULL THEN {w} END) AS fb, sum(rn * ({w})) / sum(CASE WHEN rn IS NOT NULL THEN {w} END) AS fn FROM n WHERE r <= 3 GROUP BY id)
      SELECT c_custkey, {rnd('coalesce(bal, fb)', 'bal', 5)}, {rnd('coalesce(nation, fn)', 'nation', 5)} FROM h LEFT JOIN f ON id = c_custkey"""


_knn("imputer_knn", "uniform")
_knn("imputer_knn_distance", "distance")


# Selection


def _flag(spark, d) -> DataFrame:
    """lineitem with a class 0, 1 or 2 from l_returnflag."""
    return lineitem(spark, d, "l_returnflag").withColumn("y", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0))


_FLAGGED = "(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem)"


def _score_rows(spark, scores: list[float]) -> DataFrame:
    return rounded(rows_of(spark, list(zip(LI, map(float, scores), strict=True)), "column string, score double"), ["score"], 5)


@query("f_classif", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rnd('(sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'score', 5)} FROM (SELECT count(*) n, avg({c}) m, var_pop({c}) v, (SELECT avg({c}) FROM lineitem) g FROM lineitem GROUP BY l_returnflag)" for c in LI))
def f_classif(spark, d):
    return _score_rows(spark, selection.f_classif(_flag(spark, d), LI, "y"))


@query("chi2", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rnd('sum(pow(s - e, 2) / e)', 'score', 5)} FROM (SELECT sum({c}) s, (SELECT sum({c}) FROM lineitem) * count(*) / (SELECT count(*) FROM lineitem) e FROM lineitem GROUP BY l_returnflag)" for c in LI))
def chi2(spark, d):
    return _score_rows(spark, selection.chi2(_flag(spark, d), LI, "y"))


@query("mutual_information", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {rnd('sum(n / t * ln(n * t / (nb * ny)))', 'score', 5)} FROM (SELECT n::DOUBLE n, (sum(n) OVER ())::DOUBLE t, (sum(n) OVER (PARTITION BY b))::DOUBLE nb, (sum(n) OVER (PARTITION BY l_returnflag))::DOUBLE ny FROM
  (SELECT l_returnflag, least(k - 1, floor(({c} - lo) / ((hi - lo) / k))) b, count(*) n FROM lineitem, (SELECT min({c}) lo, max({c}) hi, greatest(2, ceil(sqrt(count(*)))) k FROM lineitem) GROUP BY 1, 2))""" for c in LI))
def mutual_information(spark, d):
    return _score_rows(spark, selection.mutual_information(_flag(spark, d), LI, "y"))


_F_SCORES = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, (SELECT (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) FROM (SELECT count(*) n, avg({c}) m, var_pop({c}) v, (SELECT avg({c}) FROM lineitem) g FROM lineitem GROUP BY l_returnflag)) AS f" for i, c in enumerate(LI))


@query("select_k_best", f"WITH f AS ({_F_SCORES}), k AS (SELECT c FROM f ORDER BY f DESC, i LIMIT 2) SELECT {KEYS}, \"column\", value FROM (" + " UNION ALL ".join(f"SELECT {KEYS}, '{c}' AS \"column\", {c}::DOUBLE AS value FROM lineitem" for c in LI) + ') WHERE "column" IN (SELECT c FROM k)')
def select_k_best(spark, d):
    got = selection.SelectKBest(2).fit_transform(_flag(spark, d).select(*KEY, *LI, "y"), LI, "y")
    return got.unpivot(KEY, [F.col(c).cast("double").alias(c) for c in LI if c in got.columns], "column", "value")


# Linear models

_OLS1 = "SELECT covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) AS b, avg(l_extendedprice) my, avg(l_quantity) mx FROM lineitem"


@query("linear_regression", f"WITH s AS ({_OLS1}) SELECT {KEYS}, {rnd('my + b * (l_quantity - mx)', 'prediction', 3)} FROM lineitem, s")
def linear_regression(spark, d):
    df = lineitem(spark, d).select(*KEY, "l_quantity", "l_extendedprice")
    return rounded(linear.LinearRegression().fit(df, ["l_quantity"], "l_extendedprice").transform(df).select(*KEY, "prediction"), n=3)


def _two(alpha: str) -> str:
    return f"""SELECT (sxx + {alpha}) a, (szz + {alpha}) c, sxz b, sxy u, szy v, my, mx, mz FROM (SELECT covar_pop(l_quantity, l_quantity) * count(*) sxx, covar_pop(l_discount, l_discount) * count(*) szz,
      covar_pop(l_quantity, l_discount) * count(*) sxz, covar_pop(l_quantity, l_extendedprice) * count(*) sxy, covar_pop(l_discount, l_extendedprice) * count(*) szy, avg(l_extendedprice) my, avg(l_quantity) mx, avg(l_discount) mz FROM lineitem)"""


def _two_sql(alpha: str) -> str:
    return f"WITH s AS ({_two(alpha)}), b AS (SELECT (u * c - v * b) / (a * c - b * b) b0, (a * v - b * u) / (a * c - b * b) b1, my, mx, mz FROM s) SELECT {KEYS}, {rnd('my + b0 * (l_quantity - mx) + b1 * (l_discount - mz)', 'prediction', 2)} FROM lineitem, b"


@query("linear_regression_two", _two_sql("0"))
def linear_regression_two(spark, d):
    df = lineitem(spark, d)
    return rounded(linear.LinearRegression(solver="svd").fit(df, ["l_quantity", "l_discount"], "l_extendedprice").transform(df).select(*KEY, "prediction"), n=2)


@query("ridge", _two_sql("10.0"))
def ridge(spark, d):
    df = lineitem(spark, d)
    return rounded(linear.Ridge(alpha=10.0).fit(df, ["l_quantity", "l_discount"], "l_extendedprice").transform(df).select(*KEY, "prediction"), n=2)


@query("lasso", f"WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) u, var_pop(l_quantity) a, avg(l_extendedprice) my, avg(l_quantity) mx FROM lineitem), b AS (SELECT sign(u) * greatest(0, abs(u) - 100.0) / a b, my, mx FROM s) SELECT {KEYS}, {rnd('my + b * (l_quantity - mx)', 'prediction', 2)} FROM lineitem, b")
def lasso(spark, d):
    df = lineitem(spark, d)
    return rounded(linear.Lasso(alpha=100.0).fit(df, ["l_quantity"], "l_extendedprice").transform(df).select(*KEY, "prediction"), n=2)


def _status(spark, d) -> DataFrame:
    return lineitem(spark, d, "l_linestatus").withColumn("y", (F.col("l_linestatus") == "O").cast("double"))


_NEWTON2 = f"""WITH RECURSIVE c AS (SELECT l_quantity - avg(l_quantity) OVER () AS x, l_discount - avg(l_discount) OVER () AS z, (l_linestatus = 'O')::INT::DOUBLE AS y FROM lineitem),
  k AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, false AS done UNION ALL SELECT i + 1, (u * c - v * b) / (a * c - b * b), (a * v - b * u) / (a * c - b * b), greatest(abs((u * c - v * b) / (a * c - b * b) - b0), abs((a * v - b * u) / (a * c - b * b) - b1)) < 1e-4 FROM (
    SELECT i, any_value(b0) b0, any_value(b1) b1, sum(w * x * x) a, sum(w * x * z) b, sum(w * z * z) c, sum(x * (w * eta + y - p)) u, sum(z * (w * eta + y - p)) v FROM (
      SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (SELECT i, b0, b1, x, z, y, b0 * x + b1 * z AS eta FROM k, c WHERE i < 100 AND NOT done))) GROUP BY i)),
  m AS (SELECT b0, b1, ln(r / (1 - r)) - b0 * mx - b1 * mz AS b FROM (SELECT * FROM k ORDER BY i DESC LIMIT 1), (SELECT avg((l_linestatus = 'O')::INT::DOUBLE) r, avg(l_quantity) mx, avg(l_discount) mz FROM lineitem)),
  s AS (SELECT {KEYS}, 1 / (1 + exp(-(b + b0 * l_quantity + b1 * l_discount))) AS p FROM lineitem, m)"""


@query("logistic_binary", f"{_NEWTON2} SELECT {KEYS}, (p >= 0.5)::INT::DOUBLE AS prediction, {rnd('p', 'p', 5)} FROM s")
def logistic_binary(spark, d):
    df = _status(spark, d)
    m = linear.LogisticRegression().fit(df, ["l_quantity", "l_discount"], "y")
    return rounded(m.predict_proba(m.transform(df)).select(*KEY, "prediction", F.col("probability")[1].alias("p")), n=5)


_NEWTON3 = f"""WITH RECURSIVE c AS (SELECT l_quantity - avg(l_quantity) OVER () AS x, y FROM {_FLAGGED}),
  k AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, false AS done UNION ALL SELECT i + 1, b0 - s0, b1 - s1, greatest(0, s0, s1) < 1e-4 FROM (SELECT *, (u * c - v * b) / (a * c - b * b) AS s0, (a * v - b * u) / (a * c - b * b) AS s1 FROM (
    SELECT i, any_value(b0) b0, any_value(b1) b1, sum(x * x * p0 * (1 - p0)) + 1e-10 a, sum(-x * x * p0 * p1) b, sum(x * x * p1 * (1 - p1)) + 1e-10 c, sum(x * (p0 - (y = 0)::INT)) u, sum(x * (p1 - (y = 1)::INT)) v FROM (
      SELECT i, b0, b1, x, y, exp(b0 * x) / (1 + exp(b0 * x) + exp(b1 * x)) AS p0, exp(b1 * x) / (1 + exp(b0 * x) + exp(b1 * x)) AS p1 FROM k, c WHERE i < 100 AND NOT done) GROUP BY i))),
  m AS (SELECT b0, b1, mx FROM (SELECT * FROM k ORDER BY i DESC LIMIT 1), (SELECT avg(l_quantity) mx FROM lineitem)),
  e AS (SELECT {KEYS}, exp(b0 * (l_quantity - mx)) AS e0, exp(b1 * (l_quantity - mx)) AS e1 FROM lineitem, m)"""


@query("logistic_multiclass", f"{_NEWTON3} SELECT {KEYS}, {rnd('e0 / (1 + e0 + e1)', 'p0', 5)}, {rnd('e1 / (1 + e0 + e1)', 'p1', 5)}, (CASE WHEN greatest(e0, e1) <= 1 THEN 2 WHEN e1 >= e0 THEN 1 ELSE 0 END)::DOUBLE AS prediction FROM e")
def logistic_multiclass(spark, d):
    df = _flag(spark, d)
    m = linear.LogisticRegression().fit(df, ["l_quantity"], "y")
    return rounded(m.predict_proba(m.transform(df)).select(*KEY, "prediction", *(F.col("probability")[i].alias(f"p{i}") for i in (0, 1))), n=5)


# Decomposition and clustering


@query("pca_two", f"""WITH m AS (SELECT avg(l_quantity) mx, avg(l_extendedprice) my, var_samp(l_quantity) a, var_samp(l_extendedprice) c, covar_samp(l_quantity, l_extendedprice) b FROM lineitem),
  e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) l1 FROM m), v AS (SELECT *, sqrt(b * b + pow(l1 - a, 2)) n FROM e)
  SELECT {KEYS}, {rnd('abs(((l_quantity - mx) * b + (l_extendedprice - my) * (l1 - a)) / n)', 'pca0', 3)} FROM lineitem, v""")
def pca_two(spark, d):
    df = lineitem(spark, d).select(*KEY, *LI[:2])
    got = decomposition.PCA(1).fit_transform(df, LI[:2])
    return rounded(got.withColumn("pca0", F.abs("pca0")), n=3)


def wide(spark, d) -> tuple[DataFrame, list[str]]:
    cols = [f"e{i}" for i in range(64)]
    return t(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols))), cols


@query("pca_embeddings", "SELECT round(sum(v), 4) + 0.0 AS total FROM (" + " UNION ALL ".join(f"SELECT var_samp(embedding[{i + 1}]::DOUBLE) AS v FROM embeddings" for i in range(64)) + ")")
def pca_embeddings(spark, d):
    df, cols = wide(spark, d)
    m = decomposition.PCA(None).fit(df, cols)
    return rounded(rows_of(spark, [(sum(m.explained_variance),)], "total double"), n=4)


@query("truncated_svd", "SELECT round(sum(v), 3) + 0.0 AS total FROM (" + " UNION ALL ".join(f"SELECT sum(pow(embedding[{i + 1}]::DOUBLE, 2)) AS v FROM embeddings" for i in range(64)) + ")")
def truncated_svd(spark, d):
    df, cols = wide(spark, d)
    m = decomposition.TruncatedSVD(None).fit(df, cols)
    return rounded(rows_of(spark, [(float(sum(s * s for s in m.singular_values)),)], "total double"), n=3)


_MEANS = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i}" for i in range(64))


@query("pca_projection", f"WITH m AS (SELECT {_MEANS} FROM embeddings) SELECT vec_id, {rnd(' + '.join(f'pow(embedding[{i + 1}]::DOUBLE - m{i}, 2)' for i in range(64)), 'energy', 4)} FROM embeddings, m")
def pca_projection(spark, d):
    """Squared length of each row's projection on all components: that of the centred row, as components are orthonormal."""
    df, cols = wide(spark, d)
    z = decomposition.PCA(None).fit(df, cols).transform_array(t(spark, d, "embeddings"), "embedding", "z")
    return rounded(z.select("vec_id", F.aggregate("z", F.lit(0.0), lambda acc, v: acc + v * v).alias("energy")), n=4)


_LLOYD_D = [f"(pow(c_acctbal - {a!r}, 2) + pow(c_nationkey - {b!r}, 2))" for a, b in ((-500.0, 2.0), (2000.0, 12.0), (7000.0, 20.0))]


@query("kmeans_step", f"WITH x AS (SELECT *, CASE WHEN {_LLOYD_D[0]} <= {_LLOYD_D[1]} AND {_LLOYD_D[0]} <= {_LLOYD_D[2]} THEN 0 WHEN {_LLOYD_D[1]} <= {_LLOYD_D[2]} THEN 1 ELSE 2 END AS g FROM customer) SELECT g::INT AS cluster, {rnd('avg(c_acctbal)', 'bal', 4)}, {rnd('avg(c_nationkey)', 'nation', 4)} FROM x GROUP BY g")
def kmeans_step(spark, d):
    m = cluster.KMeans(3, max_iter=1).fit_from(t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], [[-500.0, 2.0], [2000.0, 12.0], [7000.0, 20.0]])
    return rounded(rows_of(spark, [(i, *c) for i, c in enumerate(m.centres)], "cluster int, bal double, nation double"), n=4)


@query("kmeans", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS cluster FROM orders")
def kmeans(spark, d):
    """Three groups far apart, found from seeds drawn by k-means++; clusters are named by their smallest key."""
    far = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1e7).otherwise(-3e7)
    numbered = stats.with_rid(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])
    df = numbered.select("o_orderkey", "rid", (far + F.col("o_totalprice")).alias("a"), (far / 2).alias("b"))
    got = cluster.KMeans(3, n_init=3, max_iter=20).fit(df, ["a", "b"]).transform(df)
    names = got.groupBy("cluster").agg(F.min("o_orderkey").alias("name"))
    return got.join(F.broadcast(names), "cluster").select("o_orderkey", F.col("name").alias("cluster"))  # one row a cluster


@query("kmeans_fit", """WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding[1:4], lambda e: e::DOUBLE) AS v FROM embeddings),
  k AS (SELECT 0 AS i, list(v ORDER BY vec_id) AS c, 1.0::DOUBLE AS shift FROM (SELECT * FROM x ORDER BY vec_id LIMIT 3) UNION ALL
    SELECT i + 1, list(m ORDER BY g), sum(list_distance(m, c[g]) ** 2) / 3 FROM (SELECT i, any_value(c) c, g, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] m FROM (
      SELECT i, c, v, list_position(list_transform(c, lambda q: list_distance(q, v)), list_min(list_transform(c, lambda q: list_distance(q, v)))) g FROM k, x WHERE i < 100 AND shift > 1e-12) GROUP BY i, g) GROUP BY i),
  e AS (SELECT i, unnest(c) AS m, generate_subscripts(c, 1) - 1 AS cluster FROM (SELECT * FROM k ORDER BY i DESC LIMIT 1))
  SELECT cluster::INT AS cluster, round(m[1], 4) + 0.0 AS e0, round(m[2], 4) + 0.0 AS e1, round(m[3], 4) + 0.0 AS e2, round(m[4], 4) + 0.0 AS e3 FROM e""")
def kmeans_fit(spark, d):
    """Lloyd's algorithm to its end, from the first three rows."""
    df, cols = wide(spark, d)
    first = [[r[c] for c in cols[:4]] for r in df.orderBy("vec_id").limit(3).collect()]
    m = cluster.KMeans(3, max_iter=100, tol=1e-12).fit_from(df, cols[:4], first)
    return rounded(rows_of(spark, [(i, *c) for i, c in enumerate(m.centres)], "cluster int, e0 double, e1 double, e2 double, e3 double"), n=4)


@query("silhouette", f"""WITH x AS (SELECT c_custkey, c_mktsegment k, c_acctbal a, c_nationkey b FROM customer),
  p AS (SELECT x.c_custkey, x.k, y.k k2, sum(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) s, count(*) n FROM x, x y GROUP BY ALL),
  m AS (SELECT c_custkey, max(CASE WHEN k = k2 THEN s / nullif(n - 1, 0) END) ai, min(CASE WHEN k <> k2 THEN s / n END) bi FROM p GROUP BY 1)
  SELECT c_custkey AS rid, {rnd('CASE WHEN ai IS NULL THEN 0 ELSE (bi - ai) / greatest(ai, bi) END', 'silhouette')} FROM m""")
def silhouette(spark, d):
    return rounded(cluster.silhouette_samples(t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment", "c_custkey"))


# Metrics: the truth is l_linestatus or l_returnflag, the prediction a fixed function of the row


def _regression(spark, d) -> DataFrame:
    return lineitem(spark, d).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@query("regression_metrics", f"WITH x AS (SELECT l_extendedprice y, l_quantity * 1500.0 p FROM lineitem) SELECT count(*) AS n, {rnd('avg(pow(y - p, 2))', 'mse', 2)}, {rnd('sqrt(avg(pow(y - p, 2)))', 'rmse', 4)}, {rnd('avg(abs(y - p))', 'mae', 4)}, {rnd('1 - avg(pow(y - p, 2)) / var_pop(y)', 'r2')}, {rnd('max(abs(y - p))', 'max_error', 4)}, {rnd('1 - var_pop(y - p) / var_pop(y)', 'explained_variance')} FROM x")
def regression_metrics(spark, d):
    got = metrics.regression_metrics(_regression(spark, d), "y", "p")
    return rounded(rounded(rounded(got, ["mse"], 2), ["rmse", "mae", "max_error"], 4), ["r2", "explained_variance"])


_CALLED = "CASE WHEN l_quantity < 17 THEN 0.0 WHEN l_quantity < 34 THEN 1.0 ELSE 2.0 END"
_LABELLED = f"(SELECT CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END::DOUBLE AS y, ({_CALLED})::DOUBLE AS p FROM lineitem)"


def _labelled(spark, d) -> DataFrame:
    return _flag(spark, d).select("y", F.expr(_CALLED).cast("double").alias("p"))


@query("confusion_matrix", f"SELECT y AS truth, p AS predicted, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_labelled(spark, d), "y", "p")


_CLASSES = f"(SELECT c, sum((y = c AND p = c)::INT)::DOUBLE h, sum((p = c)::INT)::DOUBLE k, sum((y = c)::INT)::DOUBLE s FROM {_LABELLED}, (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE c) GROUP BY c)"
_PRF = "coalesce(h / nullif(k, 0), 0) pr, coalesce(h / nullif(s, 0), 0) re, coalesce(2 * h / nullif(k + s, 0), 0) f, s"


@query("classification_report", f"SELECT c AS label, {rnd('pr', 'precision')}, {rnd('re', 'recall')}, {rnd('f', 'f1')}, s::BIGINT AS support FROM (SELECT c, {_PRF} FROM {_CLASSES})")
def classification_report(spark, d):
    return rounded(metrics.classification_report(_labelled(spark, d), "y", "p"), ["precision", "recall", "f1"])


@query("classification_averages", f"""WITH c AS (SELECT {_PRF} FROM {_CLASSES}), a AS (SELECT sum((y = p)::INT) / count(*)::DOUBLE x FROM {_LABELLED})
  SELECT 'macro' AS average, {rnd('avg(pr)', 'precision')}, {rnd('avg(re)', 'recall')}, {rnd('avg(f)', 'f1')} FROM c UNION ALL
  SELECT 'weighted', {rnd('sum(pr * s) / sum(s)', 'precision')}, {rnd('sum(re * s) / sum(s)', 'recall')}, {rnd('sum(f * s) / sum(s)', 'f1')} FROM c UNION ALL
  SELECT 'micro', {rnd('x', 'precision')}, {rnd('x', 'recall')}, {rnd('x', 'f1')} FROM a""")
def classification_averages(spark, d):
    c = metrics.Classification.of(_labelled(spark, d), "y", "p")
    return rounded(rows_of(spark, [(a, *c.scores(a)) for a in ("macro", "weighted", "micro")], "average string, precision double, recall double, f1 double"))


@query("precision_recall_binary", f"SELECT {rnd('h / k', 'precision')}, {rnd('h / s', 'recall')}, {rnd('2 * h / (k + s)', 'f1')} FROM (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE h, sum(toxic)::DOUBLE k, sum(quality)::DOUBLE s FROM labels)")
def precision_recall_binary(spark, d):
    c = metrics.Classification.of(t(spark, d, "labels"), "quality", "toxic")
    return rounded(rows_of(spark, [c.scores("binary", 1.0)], "precision double, recall double, f1 double"))


@query("agreement", f"""WITH x AS {_LABELLED}, n AS (SELECT count(*)::DOUBLE n, sum((y = p)::INT)::DOUBLE h FROM x), c AS (SELECT c, sum((p = c)::INT)::DOUBLE k, sum((y = c)::INT)::DOUBLE s FROM x, (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE c) GROUP BY c), q AS (SELECT sum(k * s) ks, sum(k * k) kk, sum(s * s) ss FROM c)
  SELECT {rnd('h / n', 'accuracy')}, {rnd('(h / n - ks / n / n) / (1 - ks / n / n)', 'kappa')}, {rnd('(h * n - ks) / sqrt((n * n - kk) * (n * n - ss))', 'mcc')} FROM n, q""")
def agreement(spark, d):
    c = metrics.Classification.of(_labelled(spark, d), "y", "p")
    return rounded(rows_of(spark, [(c.accuracy(), c.cohen_kappa(), c.matthews())], "accuracy double, kappa double, mcc double"))


_SCORED = "(SELECT (l_linestatus = 'O')::INT y, l_quantity / 51.0 s FROM lineitem)"


def _scored(spark, d) -> DataFrame:
    return _status(spark, d).select("y", (F.col("l_quantity") / 51.0).alias("s"))


@query("log_loss", f"SELECT {rnd('avg(-ln(CASE WHEN y = 1 THEN s ELSE 1 - s END))', 'log_loss')} FROM {_SCORED}")
def log_loss(spark, d):
    return rounded(rows_of(spark, [(metrics.log_loss(_scored(spark, d), "y", "s"),)], "log_loss double"))


@query("roc_auc", f"WITH g AS (SELECT s, sum(y)::DOUBLE p, sum(1 - y)::DOUBLE n FROM {_SCORED} GROUP BY s), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM g) SELECT {rnd('sum(p * (b + n / 2)) / (sum(p) * sum(n))', 'roc_auc')} FROM c")
def roc_auc(spark, d):
    return rounded(rows_of(spark, [(metrics.roc_auc_score(_scored(spark, d), "y", "s"),)], "roc_auc double"))


@query("average_precision", f"WITH g AS (SELECT s, sum(y)::DOUBLE p, count(*)::DOUBLE k FROM {_SCORED} GROUP BY s), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) tp, sum(k) OVER (ORDER BY s DESC) tk FROM g) SELECT {rnd('sum(p * tp / tk) / sum(p)', 'average_precision')} FROM c")
def average_precision(spark, d):
    return rounded(rows_of(spark, [(metrics.average_precision_score(_scored(spark, d), "y", "s"),)], "average_precision double"))


# Splits


def _numbered(spark, d) -> DataFrame:
    return stats.with_rid(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


_RID = "(SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid, count(*) OVER () AS n FROM orders)"


@query("train_test_split", f"SELECT o_orderkey, (rid < ceil(n * 0.25)) AS is_test FROM {_RID}")
def train_test_split(spark, d):
    train, test = splits.train_test_split(_numbered(spark, d), 0.25, shuffle=False)
    return train.select("o_orderkey", F.lit(False).alias("is_test")).unionByName(test.select("o_orderkey", F.lit(True).alias("is_test")))


def _shuffled_sql(seed: int, segments: str, order: str) -> str:
    """CTEs up to p(rid, place): customers shuffled from the last place down, within each of segments(s, n), by xorshift64 (13, 7, 17)."""
    return f"""WITH RECURSIVE r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS rid FROM customer), seg AS ({segments}),
      steps AS (SELECT row_number() OVER (ORDER BY s, i DESC) AS t, s::BIGINT AS s, i::BIGINT AS i FROM (SELECT s, unnest(range(1, n)) AS i FROM seg)),
      f AS (SELECT 0::BIGINT AS t, {seed}::UBIGINT AS x, (SELECT list(rid ORDER BY {order}) FROM r) AS l UNION ALL
        SELECT t, x, list_transform(l, lambda v, k: CASE WHEN k = s + i + 1 THEN l[s + j + 1] WHEN k = s + j + 1 THEN l[s + i + 1] ELSE v END) FROM (
          SELECT *, floor((x >> 11)::DOUBLE / 9007199254740992.0 * (i + 1))::BIGINT AS j FROM (
            SELECT t, l, s, i, xor(x, (x & 140737488355327::UBIGINT) << 17) AS x FROM (SELECT t, l, s, i, xor(x, x >> 7) AS x FROM (
              SELECT steps.t AS t, l, s, i, xor(x, (x & 2251799813685247::UBIGINT) << 13) AS x FROM f JOIN steps ON steps.t = f.t + 1))))),
      p AS (SELECT unnest(l) AS rid, generate_subscripts(l, 1) - 1 AS place FROM (SELECT l FROM f ORDER BY t DESC LIMIT 1))"""


_WHOLE, _BY_SEGMENT = "SELECT 0 AS s, count(*) AS n FROM r", "SELECT sum(n) OVER (ORDER BY c_mktsegment) - n AS s, n FROM (SELECT c_mktsegment, count(*) AS n FROM r GROUP BY 1)"


def _customers(spark, d) -> DataFrame:
    return stats.with_rid(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query("train_test_split_shuffled", f"{_shuffled_sql(42, _WHOLE, 'rid')} SELECT c_custkey FROM p JOIN r USING (rid) WHERE place < (SELECT ceil(count(*) * 0.25) FROM r)")
def train_test_split_shuffled(spark, d):
    return splits.train_test_split(_customers(spark, d), 0.25, True, 42)[1].select("c_custkey")


@query("kfold_shuffled", f"{_shuffled_sql(3, _WHOLE, 'rid')} SELECT c_custkey, (CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1) ELSE (place - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END)::INT AS fold FROM p JOIN r USING (rid), (SELECT count(*) AS n FROM r)")
def kfold_shuffled(spark, d):
    return splits.KFold(7, True, 3).assign(_customers(spark, d)).select("c_custkey", "fold")


@query("stratified_kfold_shuffled", f"{_shuffled_sql(3, _BY_SEGMENT, 'c_mktsegment, rid')} SELECT c_custkey, (place % 5)::INT AS fold FROM p JOIN r USING (rid)")
def stratified_kfold_shuffled(spark, d):
    return splits.StratifiedKFold(5, True, 3).assign(_customers(spark, d), "c_mktsegment").select("c_custkey", "fold")


@query("kfold", f"SELECT o_orderkey, (CASE WHEN rid < (n % 7) * (n // 7 + 1) THEN rid // (n // 7 + 1) ELSE (rid - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END)::INT AS fold FROM {_RID}")
def kfold(spark, d):
    return splits.KFold(7).assign(_numbered(spark, d)).select("o_orderkey", "fold")


@query("stratified_kfold", f"SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderstatus, rid) - 1) % 5)::INT AS fold FROM {_RID}")
def stratified_kfold(spark, d):
    return splits.StratifiedKFold(5).assign(_numbered(spark, d), "o_orderstatus").select("o_orderkey", "fold")


_FOLDS = f"""WITH r AS (SELECT l_quantity x, l_discount z, l_extendedprice y, row_number() OVER (ORDER BY {KEYS}) - 1 AS rid, count(*) OVER () AS n FROM lineitem),
  f AS (SELECT *, (CASE WHEN rid < (n % 3) * (n // 3 + 1) THEN rid // (n // 3 + 1) ELSE (rid - (n % 3) * (n // 3 + 1)) // (n // 3) + n % 3 END)::INT AS fold FROM r),
  s AS (SELECT k AS fold, covar_pop(x, x) a, covar_pop(z, z) c, covar_pop(x, z) b, covar_pop(x, y) u, covar_pop(z, y) v, avg(x) mx, avg(z) mz, avg(y) my FROM f, range(3) g(k) WHERE f.fold <> k GROUP BY k),
  b AS (SELECT fold, (u * c - v * b) / (a * c - b * b) b0, (a * v - b * u) / (a * c - b * b) b1, mx, mz, my FROM s)"""


@query("cross_val_score", f"{_FOLDS} SELECT fold, {rnd('1 - sum(pow(y - (my + b0 * (x - mx) + b1 * (z - mz)), 2)) / (var_pop(y) * count(*))', 'score', 5)} FROM f JOIN b USING (fold) GROUP BY fold")
def cross_val_score(spark, d):
    df = stats.with_rid(lineitem(spark, d), KEY)
    scores = splits.cross_val_score(linear.LinearRegression(), df, ["l_quantity", "l_discount"], "l_extendedprice", splits.KFold(3))
    return rounded(rows_of(spark, [(i, s) for i, s in enumerate(scores)], "fold int, score double"), n=5)


# Composition


_Z = ", ".join(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS {c}" for c in LI)
_MM = ", ".join(f"({c} - (SELECT min({c}) FROM z)) / (SELECT max({c}) - min({c}) FROM z) AS {c}" for c in LI)
_RB = ", ".join(rnd(f"({c} - (SELECT quantile_cont({c}, 0.5) FROM m)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM m)", c, 5) for c in LI)


@query("pipeline_scalers", f"WITH z AS (SELECT {KEYS}, {_Z} FROM lineitem), m AS (SELECT {KEYS}, {_MM} FROM z) SELECT {KEYS}, {_RB} FROM m")
def pipeline_scalers(spark, d):
    p = compose.Pipeline([("z", scalers.StandardScaler()), ("m", scalers.MinMaxScaler()), ("r", scalers.RobustScaler())])
    return rounded(p.fit_transform(lineitem(spark, d), LI), LI, 5)


@query("supervised_pipeline", f"WITH s AS ({_OLS1}) SELECT {KEYS}, {rnd('my + b * (l_quantity - mx)', 'prediction', 3)} FROM lineitem, s")
def supervised_pipeline(spark, d):
    df = lineitem(spark, d).select(*KEY, "l_quantity", "l_extendedprice")
    p = compose.Pipeline([("scale", scalers.StandardScaler())]).with_estimator(linear.LinearRegression())
    return rounded(p.fit(df, ["l_quantity"], "l_extendedprice").transform(df).select(*KEY, "prediction"), n=3)


def _mixed(spark, d) -> DataFrame:
    return orders(spark, d).withColumn("price2", F.col("o_totalprice") * 2)


def _column_transformer(remainder: str):
    return compose.ColumnTransformer(
        [("scale", scalers.StandardScaler(), ["o_totalprice"]), ("status", encoders.OneHotEncoder(), ["o_orderstatus"])],
        ["o_totalprice", "price2"], ["o_orderstatus", "o_orderpriority"], remainder, ["o_orderkey"],
    )


_CT = f"{rnd('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()', 'o_totalprice', 5)}, " + ", ".join(f"(o_orderstatus = '{s}')::INT::DOUBLE AS \"o_orderstatus_{s}\"" for s in "FOP")


@query("column_transformer", f"SELECT o_orderkey, {_CT} FROM orders")
def column_transformer(spark, d):
    return rounded(_column_transformer("drop").fit_transform(_mixed(spark, d), None), n=5)


@query("column_transformer_passthrough", f"SELECT o_orderkey, {_CT}, {rnd('o_totalprice * 2', 'price2', 5)}, " + ", ".join(f"(o_orderpriority = '{p}')::INT::DOUBLE AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders")
def column_transformer_passthrough(spark, d):
    return rounded(_column_transformer("passthrough").fit_transform(_mixed(spark, d), None), n=5)


@query("column_transformer_target", f"WITH g AS (SELECT avg(o_totalprice) m FROM orders), c AS (SELECT o_orderpriority, (sum(o_totalprice) + 5 * any_value(m)) / (count(*) + 5) AS e FROM orders, g GROUP BY 1) SELECT o_orderkey, {rnd('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())', 'o_totalprice', 5)}, {rnd('e', 'o_orderpriority', 4)} FROM orders JOIN c USING (o_orderpriority)")
def column_transformer_target(spark, d):
    ct = compose.ColumnTransformer([("scale", scalers.MinMaxScaler(), ["o_totalprice"]), ("mean", encoders.TargetEncoder(5.0), ["o_orderpriority"])], ["o_totalprice"], ["o_orderpriority"], keep=["o_orderkey"])
    df = orders(spark, d)
    return rounded(rounded(ct.fit(df, None, "o_totalprice").transform(df), ["o_totalprice"], 5), ["o_orderpriority"], 4)


# Matrices


@query("select_rows", "SELECT p AS position, r_regionkey, r_name FROM (SELECT unnest([0, 1, 2])::BIGINT p, unnest([3, 1, 3]) k) JOIN region ON k = r_regionkey")
def select_rows(spark, d):
    return matrix.select_rows(t(spark, d, "region"), [3, 1, 3], "r_regionkey").select("position", "r_regionkey", "r_name")


@query("select_columns", "SELECT r_name, r_regionkey, r_name AS \"r_name__2\" FROM region")
def select_columns(spark, d):
    return matrix.select_columns(t(spark, d, "region"), ["r_name", "r_regionkey", "r_name"])


@query("matmul", f"SELECT {KEYS}, {rnd('l_quantity + 2 * l_tax', 'a', 4)}, {rnd('3 * l_quantity - l_tax', 'b', 4)} FROM lineitem")
def matmul(spark, d):
    df = lineitem(spark, d).select(*KEY, "l_quantity", "l_tax")
    return rounded(matrix.matmul(df, ["l_quantity", "l_tax"], np.array([[1.0, 3.0], [2.0, -1.0]]), ["a", "b"]), n=4)


_TRIPLES = "(SELECT l_orderkey AS \"row\", l_linenumber AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"


@query("sparse_triplets", f"SELECT \"row\", list(col::INT ORDER BY col) AS indices, list(value ORDER BY col) AS \"values\" FROM {_TRIPLES} GROUP BY 1")
def sparse_triplets(spark, d):
    tr = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value"))
    return matrix.from_triplets(tr, 16).select("row", "indices", "values")


@query("transpose", "SELECT 'r_regionkey' AS \"column\", list(r_regionkey::DOUBLE ORDER BY r_regionkey) AS \"values\" FROM region")
def transpose(spark, d):
    return matrix.transpose(t(spark, d, "region"), ["r_regionkey"], "r_regionkey")


@query("transposed_cells", 'SELECT 0::BIGINT AS "row", c_custkey AS col, c_acctbal AS value FROM customer UNION ALL SELECT 1, c_custkey, c_nationkey::DOUBLE FROM customer')
def transposed_cells(spark, d):
    return matrix.transposed_cells(t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey")


@query("matrix_constructors", "SELECT * FROM (VALUES (0::BIGINT, 'rows', 1.5::DOUBLE, 2.0::DOUBLE), (1, 'rows', 3.0, 4.0), (0, 'zeros', 0.0, 0.0), (1, 'zeros', 0.0, 0.0), (0, 'identity', 1.0, 0.0), (1, 'identity', 0.0, 1.0)) v(rid, kind, a, b)")
def matrix_constructors(spark, d):
    ab = ["a", "b"]
    made = {"rows": matrix.from_rows(spark, [[1.5, 2], [3, 4]], ab), "zeros": matrix.zeros(spark, 2, ab), "identity": matrix.identity(spark, ab)}
    first, *rest = (m.withColumn("kind", F.lit(k)) for k, m in made.items())
    for m in rest:
        first = first.unionByName(m)
    return first


@query("cell_access", """SELECT (SELECT r_name FROM region WHERE r_regionkey = 2) AS name, (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')::BIGINT AS "key", (SELECT coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 2) AS held,
  0.0::DOUBLE AS empty, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = 1) AS cells""")
def cell_access(spark, d):
    region = t(spark, d, "region")
    sparse = matrix.from_triplets(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value")), 16)
    asia = matrix.column(region, "r_name", "r_regionkey").where("value = 'ASIA'").first()["rid"]
    row = (matrix.cell(region, 2, "r_name", "r_regionkey"), matrix.row(region, asia, ["r_regionkey"], "r_regionkey")[0], matrix.sparse_get(sparse, 1, 2), matrix.sparse_get(sparse, 1, 0), len(matrix.row_nz(sparse, 1)))
    return rows_of(spark, [row], "name string, key bigint, held double, empty double, cells bigint")


# Profiler


def _profiled(spark, d) -> profile.DatasetProfile:
    return profile.profile(lineitem(spark, d, "l_returnflag", "l_linestatus"), LI, ["l_returnflag", "l_linestatus"])


def _numeric_profile_sql(c: str) -> str:
    n, m, s = f"count({c})", f"avg({c})", f"stddev_samp({c})"
    return f"""SELECT '{c}' AS name, {n} AS n, {rnd(m, 'mean', 4)}, {rnd(s, 'std', 4)}, {rnd(f'min({c})', 'min', 4)}, {rnd(f'quantile_cont({c}, 0.25)', 'q1', 4)}, {rnd(f'quantile_cont({c}, 0.5)', 'median', 4)},
      {rnd(f'quantile_cont({c}, 0.75)', 'q3', 4)}, {rnd(f'max({c})', 'max', 4)}, {rnd(f'avg(pow({c} - m, 3)) / pow(any_value(s), 3)', 'skewness', 4)}, {rnd(f'avg(pow({c} - m, 4)) / pow(any_value(s), 4) - 3', 'kurtosis', 4)} FROM lineitem, (SELECT {m} m, {s} s FROM lineitem)"""


@query("profile_numeric", " UNION ALL ".join(map(_numeric_profile_sql, LI)))
def profile_numeric(spark, d):
    fields = ("mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")
    got = profile.numeric_stats(lineitem(spark, d), {c: F.col(c) for c in LI})
    rows = [(c, sum(s.counts), *(float(getattr(s, f)) for f in fields)) for c, s in got.items()]
    return rounded(rows_of(spark, rows, "name string, n bigint, " + ", ".join(f"{f} double" for f in fields)), n=4)


@query("histogram", "WITH s AS (SELECT min(value) lo, max(value) hi, ceil(log2(count(*)) + 1)::INT k FROM events), b AS (SELECT least(k - 1, greatest(0, len(list_filter(range(1, k), lambda i: value >= lo + (hi - lo) / k * i)))) AS bin, k FROM events, s) SELECT bin::INT AS bin, count(*) AS n FROM b GROUP BY 1")
def histogram(spark, d):
    s = profile.numeric_stats(t(spark, d, "events"), {"value": F.col("value")})["value"]
    return rows_of(spark, [(i, n) for i, n in enumerate(s.counts) if n], "bin int, n bigint")


@query("histogram_shape", "WITH s AS (SELECT min(value) lo, max(value) hi, ceil(log2(count(*)) + 1)::INT k FROM events), b AS (SELECT least(k - 1, len(list_filter(range(1, k), lambda i: value >= lo + (hi - lo) / k * i))) AS bin, k FROM events, s) SELECT any_value(k)::INT AS n_bins, max(n) AS max_count FROM (SELECT bin, any_value(k) AS k, count(*) AS n FROM b GROUP BY 1)")
def histogram_shape(spark, d):
    s = profile.numeric_stats(t(spark, d, "events"), {"value": F.col("value")})["value"]
    return rows_of(spark, [(s.n_bins, s.max_count)], "n_bins int, max_count bigint")


@query("outliers", " UNION ALL ".join(f"SELECT '{c}' AS name, sum(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT)::BIGINT AS outliers FROM {tb}, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM {tb})" for c, tb in (("value", "events"), ("o_totalprice", "orders"))))
def outliers(spark, d):
    rows = [(c, profile.numeric_stats(t(spark, d, tb), {c: F.col(c)})[c].outlier_count) for c, tb in (("value", "events"), ("o_totalprice", "orders"))]
    return rows_of(spark, rows, "name string, outliers bigint")


@query("top_values", "SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def top_values(spark, d):
    got = profile.categorical_stats(orders(spark, d), ["o_orderpriority", "o_orderstatus"], "o_orderkey")
    return rows_of(spark, [(c, v, n) for c, s in got.items() for v, n in s.top_values], "column string, value string, n bigint")


@query("infer_types", "SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'categorical'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v(\"column\", kind)")
def infer_types(spark, d):
    cols = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    df = t(spark, d, "customer").select(*(F.when(F.col("c_custkey") % 9 == 0, " NA ").otherwise(F.col(c).cast("string")).alias(c) for c in cols))
    return rows_of(spark, list(profile.infer_types(df, cols).items()), "column string, kind string")


@query("pearson", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {rnd(f'corr({a}, {b})', 'value')} FROM lineitem" for a, b in itertools.combinations(LI, 2)))
def pearson(spark, d):
    found = profile.associations(lineitem(spark, d), {c: F.col(c) for c in LI}, [], "l_orderkey")
    return rounded(rows_of(spark, [(a.left, a.right, a.value) for a in found], "left string, right string, value double"))


@query("cramers_v", f"""WITH c AS (SELECT l_returnflag x, l_linestatus y, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY x) nx, sum(n) OVER (PARTITION BY y) ny, sum(n) OVER () t FROM c)
  SELECT {rnd('least(1, sqrt((sum(n * n / (nx * ny)) * any_value(t) - any_value(t)) / (any_value(t) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))))', 'value')} FROM r""")
def cramers_v(spark, d):
    return rounded(rows_of(spark, [(profile.cramers_v(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus"),)], "value double"))


@query("point_biserial", f"WITH f AS (SELECT l_linestatus z FROM lineitem ORDER BY {KEYS} LIMIT 1), x AS (SELECT (l_linestatus <> z)::INT b, l_extendedprice v FROM lineitem, f) SELECT {rnd('corr(b, v)', 'value')} FROM x")
def point_biserial(spark, d):
    df = stats.with_rid(lineitem(spark, d, "l_linestatus"), KEY)
    return rounded(rows_of(spark, [(profile.point_biserial(df, "l_linestatus", "l_extendedprice", "rid"),)], "value double"))


@query("profile_table", f"""SELECT 'value' AS name, 'numeric' AS kind, count(*) AS rows, sum((event_id % 7 = 0)::INT)::BIGINT AS missing, count(*) * 8 AS memory FROM events UNION ALL
  SELECT 'event_type', 'categorical', count(*), 0, count(*) * 24 FROM events""")
def profile_table(spark, d):
    df = holed(spark, d).join(t(spark, d, "events").select("event_id", "event_type"), "event_id")
    p = profile.profile(df, ["value"], ["event_type"], rid="event_id")
    return rows_of(spark, [(c.name, c.column_type, c.count, c.missing_count, c.memory_bytes) for c in p.columns], "name string, kind string, rows bigint, missing bigint, memory bigint")


@query("quality_findings", "SELECT * FROM (VALUES ('NearUnique', 'Info', 'c_name'), ('ConstantColumn', 'Warning', 'k'), ('HighCorrelation', 'Warning', 'c_acctbal'), ('TargetLeakage', 'Critical', 'twice')) v(kind, severity, \"column\")")
def quality_findings(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") * 2).alias("twice"), F.lit(1.0).alias("k"))
    p = profile.profile(df, ["c_acctbal", "twice", "k"], ["c_name"], "c_acctbal", "c_custkey")
    return rows_of(spark, [(f.kind, f.severity, f.column) for f in profile.run_checks(p)], "kind string, severity string, column string")


@query("quality_findings_more", "SELECT * FROM (VALUES ('HighMissing', 'Critical', 'miss'), ('Outliers', 'Info', 'far'), ('Imbalance', 'Critical', 'flag'), ('DuplicateRows', 'Warning', NULL), ('Imbalance', 'Critical', 'flag')) v(kind, severity, \"column\")")
def quality_findings_more(spark, d):
    k = F.col("c_custkey")
    df = t(spark, d, "customer").select(
        "c_custkey", F.when(k % 20 == 0, F.col("c_acctbal")).alias("miss"), F.when(k % 10 == 0, F.lit(1e9) + k).otherwise(F.col("c_acctbal")).alias("far"),
        F.when(k % 50 == 0, "y").otherwise("n").alias("flag"), (k % 5).cast("double").alias("five"),
    )
    found = [f for cols in (["miss", "far"], ["five"]) for f in profile.run_checks(profile.profile(df, cols, ["flag"], rid="c_custkey")) if f.kind not in ("HighCorrelation",)]
    return rows_of(spark, [(f.kind, f.severity, f.column) for f in found], "kind string, severity string, column string")


_CARDS = """SELECT 'n_regionkey' AS name, 'numeric' AS kind, count(*)::VARCHAR AS "count", printf('%.4f', avg(n_regionkey)) AS mean, printf('%.4f', stddev_samp(n_regionkey)) AS std, printf('%.4f', quantile_cont(n_regionkey, 0.5)) AS median, NULL AS "unique" FROM nation
  UNION ALL SELECT 'n_name', 'categorical', count(*)::VARCHAR, NULL, NULL, NULL, count(DISTINCT n_name)::VARCHAR FROM nation"""
_FIELDS = ("mean", "std", "median", "unique")


def _nations(spark, d) -> profile.DatasetProfile:
    return profile.profile(t(spark, d, "nation"), ["n_regionkey"], ["n_name"], rid="n_nationkey")


@query("report_html", _CARDS)
def report_html(spark, d):
    """What the page's cards say of each column."""
    page = report.to_html(_nations(spark, d))
    cards = [dict([("name", name), *re.findall("<tr><td>([^<]*)</td><td>([^<]*)</td></tr>", body)]) for name, body in re.findall(r'<div class="card"><h3>([^<]*)</h3><table>(.*?)</table>', page)]
    return rows_of(spark, [(c["name"], c["type"], c["count"], *(c.get(k) for k in _FIELDS)) for c in cards], "name string, kind string, count string, " + ", ".join(f"{k} string" for k in _FIELDS))


@query("report_json", _CARDS)
def report_json(spark, d):
    """The same from the JSON report."""
    columns = json.loads(report.to_json(_nations(spark, d)))["profile"]["columns"]
    told = [(c, {**{k: report.number(v) for k, v in (c["numeric"] or {}).items() if k in _FIELDS}, **({"unique": str(c["categorical"]["unique"])} if c["categorical"] else {})}) for c in columns]
    return rows_of(spark, [(c["name"], c["column_type"], str(c["count"]), *(f.get(k) for k in _FIELDS)) for c, f in told], "name string, kind string, count string, " + ", ".join(f"{k} string" for k in _FIELDS))


@query("model_roundtrip", f"WITH s AS (SELECT avg(l_tax) m, stddev_pop(l_tax) s FROM lineitem) SELECT {KEYS}, {rnd('(l_tax - m) / s', 'l_tax')} FROM lineitem, s")
def model_roundtrip(spark, d):
    df = lineitem(spark, d).select(*KEY, "l_tax")
    model = scalers.StandardScaler().fit(df, ["l_tax"])
    return rounded(type(model).from_json(model.to_json()).transform(df))

