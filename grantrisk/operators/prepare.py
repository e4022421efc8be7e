"""Feature preparation (G1-G11): encoders, imputers, scalers, assembly.

Fitting numerics computes one small statistics row; applying it is a
projection with literals, so it stays inside whole-stage code generation.
Categories are coded by joining a code table, which never leaves the cluster:
the driver learns how many codes a column has, not which.

Scaling follows the population-deviation convention (constant columns get
scale 1, so they map to 0), which differs from Spark's ``StandardScaler``
(sample deviation).
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from grantrisk import schemas
from grantrisk.operators import ranking
from grantrisk.session import cut_lineage

MAX_WIDE_CATEGORIES = 1000


# -- G5 / F2 ------------------------------------------------------------------

def fill_categories(df: DataFrame, cols: Sequence[str], token: str = schemas.MISSING) -> DataFrame:
    """Constant imputation of categorical NULLs."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in cols})


# -- O5 / G3: first-seen category codes ------------------------------------------

def first_seen_codes(df: DataFrame, cols: Sequence[str], row_id: str,
                     token: str = schemas.MISSING, n_buckets: int | None = None) -> DataFrame:
    """(column, value, code), codes 0.. in order of first appearance.

    "Appearance" is the order of ``row_id``; NULL counts as ``token``.  The
    distinct-value table is ranked per column with bucketed running counts,
    so a high-cardinality column never lands in one task.
    """
    filled = fill_categories(df.select(row_id, *cols), cols, token)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))
                                for c in cols]))
    pairs = filled.select(F.col(row_id).alias("__rid"), stack.alias("__p")) \
        .select("__rid", "__p.column", "__p.value")
    first = pairs.groupBy("column", "value").agg(F.min("__rid").alias("first_row"))
    first = ranking.quantile_bucket(first, "first_row", n_buckets)
    ranked = ranking.row_number_global(first, [F.col("first_row"), F.col("value")], "__bucket",
                                       ["column"], out="__rn")
    return ranked.select("column", "value", (F.col("__rn") - 1).cast("int").alias("code"), "first_row")


def apply_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str],
                token: str = schemas.MISSING, suffix: str = "_code") -> DataFrame:
    """G3 as a join: category -> ordinal code (unknown value -> NULL).

    The code table is joined per column; Catalyst/AQE broadcast it when it is
    small and shuffle-join it otherwise (no unchecked broadcast hint).
    """
    out = fill_categories(df, cols, token)
    for c in cols:
        m = codes.filter(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"),
                                                       F.col("code").alias(c + suffix))
        out = out.join(m, out[c] == m[f"__v_{c}"], "left").drop(f"__v_{c}")
    return out


# -- G1: wide one-hot -------------------------------------------------------------

def onehot_wide(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_WIDE_CATEGORIES,
                values: dict[str, list[str]] | None = None) -> DataFrame:
    """G1: ``col_value`` indicator columns (sorted values), NULL -> all zeros.

    Wide tables are only sensible for low-cardinality columns; above
    ``max_categories`` distinct values use :func:`onehot_sparse`.
    """
    if values is None:
        values = {}
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                    for c in cols]))
        dist = df.select(stack.alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull()).distinct()
        counts = {r["c"]: r["n"] for r in dist.groupBy("c").agg(F.count("*").alias("n")).collect()}
        too_wide = [c for c, n in counts.items() if n > max_categories]
        if too_wide:
            raise ValueError(f"columns {too_wide} exceed {max_categories} categories; "
                             "use onehot_sparse for them")
        for r in dist.collect():
            values.setdefault(r["c"], []).append(r["v"])
    new = {}
    for c in cols:
        for v in sorted(values.get(c, [])):
            new[f"{c}_{v}"] = F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).cast("int")
    return df.withColumns(new).drop(*cols) if new else df.drop(*cols)


def code_offsets(codes: DataFrame, cols: Sequence[str], start: int = 0) -> dict[str, int]:
    """Index of each column's code 0 when the columns' codes are laid out in a row (one number per column)."""
    n = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    out = {}
    for c in cols:
        out[c], start = start, start + n.get(c, 0)
    return out


def onehot_sparse(df: DataFrame, codes: DataFrame, cols: Sequence[str], out: str = "onehot") -> DataFrame:
    """G1 for any cardinality: ``out`` holds the sorted indices of a row's ones.

    Index = the column's offset + the value's code (see
    :func:`first_seen_codes`); a NULL has none.  ``cols`` are dropped.  Codes
    are joined, so the number of categories is bounded by nothing.
    """
    at = code_offsets(codes, cols)
    coded = df
    for c in cols:
        m = codes.filter(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__k_{c}"))
        coded = coded.join(m, F.col(c).cast("string") == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    ones = F.array_compact(F.array(*[F.col(f"__k_{c}").cast("bigint") + at[c] for c in cols]))
    return coded.withColumn(out, ones).drop(*cols, *[f"__k_{c}" for c in cols])


# -- G4, G6, G7, G8: numeric statistics and scaling ----------------------------------

@dataclass
class NumericStats:
    cols: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std_pop: dict[str, float] = field(default_factory=dict)
    max_abs: dict[str, float] = field(default_factory=dict)
    present: dict[str, int] = field(default_factory=dict)
    count: int = 0


def fit_numeric(df: DataFrame, cols: Sequence[str]) -> NumericStats:
    """One aggregation: mean, population deviation, max |x| and non-missing
    count per column (NaN counts as missing)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}"),
                 F.max(F.abs(x)).alias(f"a_{c}"), F.count(x).alias(f"c_{c}")]
    r = df.agg(*aggs).first()
    st = NumericStats(list(cols), count=int(r["__n"]))
    for c in cols:
        st.mean[c] = r[f"m_{c}"]
        st.std_pop[c] = r[f"s_{c}"]
        st.max_abs[c] = r[f"a_{c}"]
        st.present[c] = int(r[f"c_{c}"])
    return st


def imputed_stats(st: NumericStats) -> NumericStats:
    """Statistics of the mean-imputed columns, derived without another pass.

    Filling the gaps with the mean keeps the mean, scales the population
    variance by present/n and can only add |mean| as a new absolute value.
    """
    out = NumericStats(list(st.cols), count=st.count)
    for c in st.cols:
        m, s, a, k, n = st.mean[c], st.std_pop[c], st.max_abs[c], st.present[c], st.count
        out.mean[c] = m
        out.present[c] = n if m is not None else k
        out.std_pop[c] = s * math.sqrt(k / n) if (s is not None and n) else s
        out.max_abs[c] = max(a, abs(m)) if (a is not None and m is not None and k < n) else a
    return out


def impute_mean(df: DataFrame, st: NumericStats) -> DataFrame:
    """NULL/NaN -> column mean (as ``SimpleImputer(strategy='mean')``)."""
    out = {}
    for c in st.cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        m = st.mean[c]
        out[c] = F.coalesce(x, F.lit(m).cast("double")) if m is not None else x
    return df.withColumns(out)


_EPS = 2.220446049250313e-16


def _scale(v: float | None) -> float:
    return 1.0 if v is None or v == 0.0 or math.isnan(v) else float(v)


def is_constant(st: NumericStats, c: str) -> bool:
    """Variance within floating error of 0 (see :func:`std_scale`)."""
    s, m, n = st.std_pop[c], st.mean[c] or 0.0, st.count
    if s is None or math.isnan(s):
        return True
    var = s * s
    return var <= n * _EPS * var + (n * m * _EPS) ** 2


def std_scale(st: NumericStats, c: str) -> float:
    """Deviation used to scale ``c``; 1 for (numerically) constant columns.

    A column is constant when its variance is within floating error of 0:
    ``var <= n eps var + (n mean eps)^2`` — e.g. a ratio ``0.8 p / p`` that
    differs from 0.8 only in the last bit is constant, not noise blown up
    to unit variance.
    """
    return 1.0 if is_constant(st, c) else float(st.std_pop[c])


def standardize(df: DataFrame, st: NumericStats, with_mean: bool = True) -> DataFrame:
    """(x - mean) / population deviation; constant column -> scale 1.

    Centred constant columns are exactly 0 (not float noise around 0): a
    learner that rescales features internally would otherwise divide by a
    deviation of ~1e-16.
    """
    out = {}
    for c in st.cols:
        x = F.col(c).cast("double")
        if with_mean and is_constant(st, c):
            out[c] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))
            continue
        if with_mean:
            x = x - F.lit(st.mean[c] or 0.0)
        out[c] = x / F.lit(std_scale(st, c))
    return df.withColumns(out)


def maxabs_scale(df: DataFrame, st: NumericStats) -> DataFrame:
    """X / max |x|; max 0 -> 1."""
    return df.withColumns({c: F.col(c).cast("double") / F.lit(_scale(st.max_abs[c])) for c in st.cols})


# -- G2, G9, G10, G11: vector preparation ------------------------------------------------

def indexed(df: DataFrame, codes: DataFrame, cat: Sequence[str]) -> DataFrame:
    """``{c}_idx`` (double) by joining the code table; a category without a code is an error."""
    out = apply_codes(df, codes, cat, suffix="_idx")
    return out.withColumns({f"{c}_idx": F.coalesce(
        F.col(f"{c}_idx").cast("double"),
        F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.col(c))).cast("double")) for c in cat})


@dataclass
class TreePrep:
    """Fitted tree preparation: numeric means and the category-code table."""
    stats: NumericStats
    codes: DataFrame
    cat: list[str]
    out: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        x = indexed(impute_mean(df, self.stats), self.codes, self.cat)
        return x.withColumn(self.out, array_to_vector(F.array(
            *[F.col(c).cast("double") for c in self.stats.cols], *[F.col(f"{c}_idx") for c in self.cat])))


def tree_pipeline(df: DataFrame, num: Sequence[str], cat: Sequence[str], row_id: str,
                  out: str = "features", codes: DataFrame | None = None) -> tuple[TreePrep, DataFrame]:
    """G9 (tree): mean-impute numerics, first-seen ordinal codes, assemble.

    Returns the fitted preparation and the category-code table.
    """
    codes = codes if codes is not None else cut_lineage(first_seen_codes(df, cat, row_id))
    return TreePrep(fit_numeric(df, num), codes, list(cat), out), codes


@dataclass
class LinearPrep:
    """Fitted linear preparation: numeric statistics, category codes and how many codes each column has.

    Vectors are put together from the codes, as ``OneHotEncoder`` and
    ``VectorAssembler`` do, without these: they describe every component by
    name in the column's metadata, which the driver then parses with each
    schema.  Here the metadata tell the width only; names are a table
    (:func:`feature_names`).
    """
    stats: NumericStats
    imputed_stats: NumericStats
    codes: DataFrame
    sizes: dict[str, int]
    cat: list[str]
    out: str = "features"

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` of every row (default: all columns) with its vector, as a staged table."""
        keep = list(keep if keep is not None else df.columns)
        x = indexed(standardize(impute_mean(df, self.stats), self.imputed_stats), self.codes, self.cat)
        rows = x.select(*[F.col(f"`{c}`") for c in keep if c != self.out], self._vector().alias(self.out))
        width = len(self.stats.cols) + sum(self.sizes.values())
        fields = [f for f in rows.schema.fields if f.name != self.out]
        field = StructField(self.out, VectorUDT(), True, {"ml_attr": {"num_attrs": width}})
        return cut_lineage(rows, schema=StructType([*fields, field]))

    def _vector(self) -> Column:
        """The stored form of a row's vector: sparse, or dense where that is smaller."""
        num = [F.when(F.col(c).isNull() | F.isnan(c), F.raise_error(F.lit(f"no number in {c}")).cast("double")).otherwise(F.col(c)) for c in self.stats.cols]
        at, width = [], len(num)
        for c in self.cat:
            at.append((F.col(f"{c}_idx").cast("int") + width).cast("int"))
            width += self.sizes[c]
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(num)],
                        *[F.struct(a.alias("i"), F.lit(1.0).alias("x")) for a in at])
        stored = F.filter(pairs, lambda p: p["x"] != 0)
        kind = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
        sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), stored["i"].alias("indices"), stored["x"].alias("values")).cast(kind)
        if width >= 1.5 * (len(num) + len(at) + 1):
            return sparse
        # so narrow that rows may be smaller written out
        ones = [F.when(F.col(f"{c}_idx") == k, 1.0).otherwise(0.0) for c in self.cat for k in range(self.sizes[c])]
        dense = F.struct(F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<int>").alias("indices"),
                         F.array(*num, *ones).alias("values")).cast(kind)
        return F.when(1.5 * (F.size(stored) + 1) < width, sparse).otherwise(dense)

    def save(self, path: str) -> None:
        """Statistics and sizes as a one-row table, codes as a table."""
        doc = json.dumps({"stats": asdict(self.stats), "imputed": asdict(self.imputed_stats), "sizes": self.sizes, "cat": self.cat, "out": self.out})
        self.codes.sparkSession.createDataFrame([(doc,)], "doc string").write.mode("overwrite").parquet(f"{path}/stats")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @staticmethod
    def load(path: str) -> "LinearPrep":
        spark = SparkSession.getActiveSession()
        doc = json.loads(spark.read.parquet(f"{path}/stats").first()["doc"])
        return LinearPrep(NumericStats(**doc["stats"]), NumericStats(**doc["imputed"]), spark.read.parquet(f"{path}/codes"),
                          doc["sizes"], doc["cat"], doc["out"])


def linear_pipeline(df: DataFrame, num: Sequence[str], cat: Sequence[str], row_id: str,
                    out: str = "features", codes: DataFrame | None = None) -> tuple[LinearPrep, DataFrame]:
    """G9 (linear): mean-impute + population-standardise numerics, one-hot
    categoricals in first-seen order (sparse; unknown category is an error)."""
    codes = codes if codes is not None else cut_lineage(first_seen_codes(df, cat, row_id))
    st = fit_numeric(df, num)
    last = {r["column"]: r["last"] for r in codes.groupBy("column").agg(F.max("code").alias("last")).collect()}  # a row per column
    sizes = {c: int(last.get(c) or 0) + 1 for c in cat}  # a column without codes has one place, as in an encoder
    return LinearPrep(st, imputed_stats(st), codes, sizes, list(cat), out), codes


def transform(model, df: DataFrame, cat: Sequence[str] = ()) -> DataFrame:
    return model.transform(df)


def feature_names(codes: DataFrame, num: Sequence[str], cat: Sequence[str], kind: str = "linear") -> DataFrame:
    """(idx, name) of a matrix as a table.

    Tree: a name per column.  Linear: the numerics, then ``{column}_oh_{value}``
    for every category in code order.
    """
    spark = codes.sparkSession
    if kind == "tree":
        return spark.createDataFrame(list(enumerate([*num, *[f"{c}_idx" for c in cat]])), "idx int, name string")
    at = code_offsets(codes, cat, len(num))
    offset = F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for c, i in at.items()])
    ones = codes.select((offset + F.col("code")).cast("int").alias("idx"), F.concat("column", F.lit("_oh_"), "value").alias("name"))
    return spark.createDataFrame(list(enumerate(num)), "idx int, name string").unionByName(ones)


def vector_entries(df: DataFrame, col: str = "features") -> DataFrame:
    """``df`` with ``entries`` for the vector: its stored (idx, value) pairs, zeros left out.

    Sparse vectors are read as they are stored, never widened.
    """
    v = F.unwrap_udt(F.col(col))
    idx = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    pairs = F.arrays_zip(idx.alias("idx"), v["values"].alias("value"))  # compiled, a lambda is not
    return df.withColumn("entries", F.filter(pairs, lambda p: p["value"] != 0))
