"""Dataset profiles: types, statistics, distributions, associations, duplicates. A few jobs, whatever the row count."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidConfig
from ..functions.exprs import is_missing, num, parsed, trimmed
from ..plans.quantiles import exact_quantiles
from .stats import correlation, duplicate_rows, with_rid

#: Most frequent values that a profile lists.
TOP_VALUES = 8
#: Quantiles of the five-number summary.
FIVE = (0.0, 0.25, 0.5, 0.75, 1.0)


@dataclass
class NumericStats:
    mean: float
    std: float | None
    min: float
    q1: float
    median: float
    q3: float
    max: float
    skewness: float
    kurtosis: float
    edges: list[float]
    counts: list[int]
    outlier_count: int
    outlier_fraction: float

    @property
    def n_bins(self) -> int:
        return len(self.counts)

    @property
    def max_count(self) -> int:
        """Rows of the fullest bin."""
        return max(self.counts, default=0)


@dataclass
class CategoricalStats:
    unique: int
    top: str
    freq: int
    imbalance_ratio: float
    top_values: list[tuple[str, int]]


@dataclass
class ColumnProfile:
    name: str
    column_type: str
    count: int
    missing_count: int
    missing_fraction: float
    memory_bytes: int
    numeric: NumericStats | None = None
    categorical: CategoricalStats | None = None


@dataclass
class Association:
    kind: str
    left: str
    right: str
    value: float


@dataclass
class DatasetProfile:
    n_rows: int
    n_columns: int
    memory_bytes: int
    duplicate_rows: int
    duplicate_fraction: float
    columns: list[ColumnProfile]
    associations: list[Association] = field(default_factory=list)
    target: str | None = None

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def association(self, kind: str, left: str, right: str) -> float | None:
        return next((a.value for a in self.associations if a.kind == kind and {a.left, a.right} == {left, right}), None)

    def to_dict(self) -> dict:
        return asdict(self)


def sturges_bins(n: int) -> int:
    return 1 if n <= 1 else math.ceil(math.log2(n) + 1)


def histogram_edges(n: int, low: float, high: float) -> list[float]:
    """Edges of equally wide bins, the last one exactly the maximum; one bin where there is no spread."""
    if n == 1 or low == high:
        return [low, high]
    bins = sturges_bins(n)
    width = (high - low) / bins
    return [*(low + width * b for b in range(bins)), high]


def bin_of(v: Column, edges: list[float]) -> Column:
    """Number of the bin: how many inner edges are at or under the value."""
    return sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def infer_types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """numeric for string columns that hold a value, and only numbers besides missing markers; else categorical."""
    asks = []
    for i, c in enumerate(cols):
        s = F.col(f"`{c}`").cast("string")
        asks += [F.sum((~is_missing(s)).cast("long")).alias(f"p{i}"), F.sum((~is_missing(s) & parsed(s).isNull()).cast("long")).alias(f"w{i}")]
    row = df.agg(*asks).first() if cols else None
    return {c: "numeric" if row[f"p{i}"] and not row[f"w{i}"] else "categorical" for i, c in enumerate(cols)}


def _finite(v: Column) -> Column:
    """A number; null where it is missing, NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def numeric_stats(df: DataFrame, values: dict[str, Column]) -> dict[str, NumericStats | None]:
    """Statistics of columns given as expressions that are null where missing: one pass of moments, one of quantiles, one of what builds on these."""
    names = list(values)
    if not names:
        return {}
    plain = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values.values())))
    row = plain.agg(*(f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp)))).first()
    present = [i for i in range(len(names)) if row[f"n{i}"]]
    if not present:
        return dict.fromkeys(names)
    five = exact_quantiles(plain, {f"v{i}": list(FIVE) for i in present}, max(row[f"n{i}"] for i in present))
    edges, asks = {}, []
    for i in present:
        low, q1, _, q3, high = five[f"v{i}"]
        edges[i] = histogram_edges(row[f"n{i}"], low, high)
        v, d = F.col(f"v{i}"), F.col(f"v{i}") - F.lit(row[f"m{i}"])
        outside = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        asks += [F.avg(d * d * d).alias(f"c{i}"), F.avg(d * d * d * d).alias(f"d{i}"), F.sum(outside.cast("long")).alias(f"o{i}")]
    more = plain.agg(*asks).first()
    items = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.col(f"v{i}").isNotNull(), bin_of(F.col(f"v{i}"), edges[i])).alias("b")) for i in present))
    bins = {(r["i"], r["b"]): r["n"] for r in plain.select(F.inline(items)).where("b is not null").groupBy("i", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict[str, NumericStats | None] = dict.fromkeys(names)
    for i in present:
        n, s = row[f"n{i}"], row[f"s{i}"]
        low, q1, q2, q3, high = five[f"v{i}"]
        spread = s is not None and s > 0
        skew = more[f"c{i}"] / s**3 if n >= 3 and spread else 0.0
        kurt = more[f"d{i}"] / s**4 - 3 if n >= 4 and spread else 0.0
        counts = [bins.get((i, b), 0) for b in range(len(edges[i]) - 1)]
        out[names[i]] = NumericStats(row[f"m{i}"], s, low, q1, q2, q3, high, skew, kurt, edges[i], counts, more[f"o{i}"], more[f"o{i}"] / n)
    return out


def value_counts(df: DataFrame, cols: list[str], rid: str) -> DataFrame:
    """(column, value, n, first): counts of trimmed values that aren't missing, and the first row of each."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), trimmed(F.col(f"`{c}`").cast("string")).alias("value"), is_missing(F.col(f"`{c}`").cast("string")).alias("gone")) for c in cols))
    return df.select(F.col(f"`{rid}`").alias("__rid"), F.inline(items)).where("not gone").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("__rid").alias("first"))


def categorical_stats(df: DataFrame, cols: list[str], rid: str) -> dict[str, CategoricalStats | None]:
    """Distinct and most frequent values; of equally frequent ones the first seen leads."""
    if not cols:
        return {}
    counts = value_counts(df, cols, rid)
    sums = {r["column"]: r for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("total")).collect()}
    # A top list of each task's values first, so that no column's values meet in one task.
    pair = F.struct((-F.col("n")).alias("minus"), "first", "value")
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("column", "salt").orderBy(pair))).where(F.col("place") <= TOP_VALUES)
    best = ranked.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(pair))).where(F.col("place") <= TOP_VALUES)
    top: dict[str, list] = {}
    for r in best.orderBy("column", "place").collect():
        top.setdefault(r["column"], []).append((r["value"], r["n"]))
    return {c: CategoricalStats(sums[c]["unique"], top[c][0][0], top[c][0][1], top[c][0][1] / sums[c]["total"], top[c]) if c in top else None for c in cols}


def _values(c: str) -> Column:
    """The trimmed string of a column; null where it is missing."""
    s = F.col(f"`{c}`").cast("string")
    return F.when(~is_missing(s), trimmed(s))


def cramers_all(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float]:
    """Cramér's V of each two columns, without bias correction, in one pass of counts; rows with either missing are left out."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return {}
    plain = df.select(*(_values(c).alias(f"s{i}") for i, c in enumerate(cols)))
    items = F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"s{i}").alias("x"), F.col(f"s{j}").alias("y")) for p, (i, j) in enumerate(pairs)))
    cells = plain.select(F.inline(items)).where("x is not null and y is not null").groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("p", "x").agg(F.sum("n").alias("nx"))
    columns = cells.groupBy("p", "y").agg(F.sum("n").alias("ny"))
    share = F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))
    sums = {r["p"]: r for r in cells.join(rows, ["p", "x"]).join(columns, ["p", "y"]).groupBy("p").agg(F.sum(share).alias("s"), F.sum("n").alias("n")).collect()}
    levels = {(r["p"], r["side"]): r["levels"] for r in rows.select("p", F.lit(0).alias("side")).unionByName(columns.select("p", F.lit(1).alias("side"))).groupBy("p", "side").agg(F.count(F.lit(1)).alias("levels")).collect()}
    out = {}
    for p, (i, j) in enumerate(pairs):
        least = min(levels.get((p, side), 0) for side in (0, 1))
        n = sums[p]["n"] if p in sums else 0
        out[cols[i], cols[j]] = 0.0 if least < 2 else min(1.0, math.sqrt(max(0.0, sums[p]["s"] * n - n) / (n * (least - 1))))
    return out


def cramers_v(df: DataFrame, a: str, b: str) -> float:
    """Association of two categorical columns."""
    return cramers_all(df, [a, b])[a, b]


def _biserial(groups: list) -> float | None:
    """From (n, mean, variance) of the two groups in order."""
    (n0, m0, v0), (n1, m1, v1) = groups
    n = n0 + n1
    if not n0 or not n1 or n < 3:
        return None
    mean = (n0 * m0 + n1 * m1) / n
    squares = n0 * (v0 + (m0 - mean) ** 2) + n1 * (v1 + (m1 - mean) ** 2)
    if squares == 0:
        return 0.0
    return max(-1.0, min(1.0, (m1 - m0) / math.sqrt(squares / (n - 1)) * math.sqrt(n0 * n1 / (n * (n - 1)))))


def biserial_all(df: DataFrame, categorical: list[str], values: dict[str, Column], rid: str) -> dict[tuple[str, str], float | None]:
    """Correlation of each number with each categorical column of exactly two values, the first seen as 0; None where undefined.

    One pass finds the columns of two values, one takes all moments.
    """
    if not categorical or not values:
        return {}
    unique = {r["column"]: r["n"] for r in value_counts(df, categorical, rid).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    binary = [c for c in categorical if unique.get(c) == 2]
    if not binary:
        return {}
    names = list(values)
    items = F.array(*(F.struct(F.lit(c).alias("c"), _values(c).alias("k")) for c in binary))
    plain = df.select(F.col(f"`{rid}`").alias("__rid"), *(v.alias(f"v{i}") for i, v in enumerate(values.values())), items.alias("__items")).select("*", F.inline("__items"))
    asks = [f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("m", F.avg), ("s", F.var_pop))]
    groups: dict[str, list] = {}
    for r in plain.where("k is not null").groupBy("c", "k").agg(F.min("__rid").alias("first"), *asks).orderBy("c", "first").collect():
        groups.setdefault(r["c"], []).append(r)
    return {(c, v): _biserial([(g[f"n{i}"], g[f"m{i}"], g[f"s{i}"]) for g in groups[c]]) for c in binary for i, v in enumerate(names)}


def point_biserial(df: DataFrame, categorical: str, numeric: str | Column, rid: str) -> float | None:
    """Correlation of a number with a categorical column of exactly two values; None where undefined."""
    v = _finite(num(numeric)) if isinstance(numeric, str) else numeric
    return biserial_all(df, [categorical], {"v": v}, rid).get((categorical, "v"))


def profile(df: DataFrame, numeric: list[str] | None = None, strings: list[str] | None = None, target: str | None = None, rid: str | None = None) -> DatasetProfile:
    """Profile these columns (all, by type, if none are named).

    String columns that hold only numbers are profiled as numbers. Non-finite numbers and the missing markers count
    as missing. rid orders the rows for what depends on which value came first; without one, the columns themselves do.
    """
    kinds = dict(df.dtypes)
    if numeric is None and strings is None:
        numeric = [c for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
        strings = [c for c, t in kinds.items() if t == "string"]
    numeric, strings = list(numeric or []), list(strings or [])
    names = [*numeric, *strings]
    if not names:
        raise EmptyInput("no columns to profile")
    if target is not None and target not in names:
        raise InvalidConfig(f"the target {target} isn't profiled")
    if rid is None:
        rid = "__order"
        df = with_rid(df.select(*(F.col(f"`{c}`") for c in names)), names, rid)
    n_rows = df.count()
    if not n_rows:
        raise EmptyInput("no rows to profile")
    kind = {c: "numeric" for c in numeric} | infer_types(df, strings)
    values = {c: _finite(num(c)) for c in numeric}
    values |= {c: _finite(parsed(F.col(f"`{c}`").cast("string"))) for c in strings if kind[c] == "numeric"}
    categorical = [c for c in strings if kind[c] == "categorical"]
    gone = {c: F.sum((values[c].isNull()).cast("long")) for c in numeric} | {c: F.sum(is_missing(F.col(f"`{c}`").cast("string")).cast("long")) for c in strings}
    missing = dict(zip(names, df.agg(*(gone[c].alias(f"g{i}") for i, c in enumerate(names))).first(), strict=True))
    stats, levels = numeric_stats(df, values), categorical_stats(df, categorical, rid)
    columns = [
        ColumnProfile(c, kind[c], n_rows, missing[c], missing[c] / n_rows, n_rows * (8 if kind[c] == "numeric" else 24), stats.get(c), levels.get(c))
        for c in names
    ]
    duplicates = duplicate_rows(df, numeric, strings).first()["duplicates"]
    found = associations(df, values, categorical, rid)
    return DatasetProfile(n_rows, len(names), sum(c.memory_bytes for c in columns), duplicates, duplicates / n_rows, columns, found, target)


def associations(df: DataFrame, values: dict[str, Column], categorical: list[str], rid: str) -> list[Association]:
    """Pearson of each two numeric columns, Cramér's V of each two categorical ones, point-biserial of binary with numeric ones."""
    out = []
    names = list(values)
    if len(names) > 1:
        plain = df.select(*(v.alias(c) for c, v in values.items()))
        r = correlation(plain, names)
        out += [Association("pearson", a, b, float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    out += [Association("cramers_v", a, b, v) for (a, b), v in cramers_all(df, categorical).items()]
    out += [Association("point_biserial", c, name, v) for (c, name), v in biserial_all(df, categorical, values, rid).items() if v is not None]
    return out


@dataclass
class Thresholds:
    missing_fraction: float = 0.5
    near_zero_variance: float = 1e-12
    near_unique_ratio: float = 0.98
    outlier_fraction: float = 0.05
    imbalance_ratio: float = 0.95
    high_correlation: float = 0.95
    target_leakage: float = 0.90


@dataclass
class Finding:
    kind: str
    severity: str
    column: str | None
    message: str


def run_checks(p: DatasetProfile, t: Thresholds | None = None) -> list[Finding]:
    """Findings about quality, from the profile alone. NaN associations never count."""
    t = t or Thresholds()
    out: list[Finding] = []

    def note(kind: str, severity: str, column: str | None, message: str) -> None:
        out.append(Finding(kind, severity, column, message))

    for c in p.columns:
        if c.count and c.missing_fraction >= t.missing_fraction:
            note("HighMissing", "Critical" if c.missing_fraction >= 0.9 else "Warning", c.name, f"{c.name}: {c.missing_fraction:.1%} of values are missing")
        if s := c.numeric:
            variance = math.nan if s.std is None else s.std * s.std
            if variance <= t.near_zero_variance:
                note("ConstantColumn", "Warning", c.name, f"{c.name}: variance of {variance:.3e}, as good as constant")
            if s.outlier_count and s.outlier_fraction >= t.outlier_fraction:
                note("Outliers", "Warning" if s.outlier_fraction >= 0.2 else "Info", c.name, f"{c.name}: {s.outlier_count} values ({s.outlier_fraction:.1%}) outside the quartile fences")
        if (k := c.categorical) and c.count:
            if k.unique / c.count >= t.near_unique_ratio:
                note("NearUnique", "Info", c.name, f"{c.name}: {k.unique} values in {c.count} rows, probably an identifier")
            if k.imbalance_ratio >= t.imbalance_ratio:
                note("Imbalance", "Critical", c.name, f"{c.name}: '{k.top}' makes up {k.imbalance_ratio:.1%}")
    if p.duplicate_rows:
        note("DuplicateRows", "Warning" if p.duplicate_fraction >= 0.1 else "Info", None, f"{p.duplicate_rows} of {p.n_rows} rows ({p.duplicate_fraction:.2%}) repeat another")
    for a in p.associations:
        size = abs(a.value)
        if a.kind == "pearson" and size >= t.high_correlation:
            note("HighCorrelation", "Warning", a.left, f"{a.left} and {a.right} correlate (r = {a.value:.3f})")
        if p.target in (a.left, a.right) and a.left != a.right and size >= t.target_leakage:
            feature = a.right if a.left == p.target else a.left
            note("TargetLeakage", "Critical", feature, f"{feature} may leak the target {p.target} ({a.kind} = {a.value:.3f})")
    return out
