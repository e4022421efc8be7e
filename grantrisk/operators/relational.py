"""Projections, filters, joins, aggregations, sorts and set operations.

(P1-P10, J1-J3, A1-A5, O1-O2, O5, U1.)  Every function is a lazy DataFrame
transformation; Catalyst pushes filters and column cuts into the scans.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantrisk import schemas


# -- projections and filters -------------------------------------------------

def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast named columns (ANSI-safe ``try_cast``: bad text -> NULL)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def keep_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """P5: exact-match filter; NULL is never kept."""
    return df.filter(F.col(col).isin(list(values)))


def union_of_filters(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """UNION ALL of one exact-match subset per value.

    Equal as a bag to :func:`keep_values` because the predicates are
    disjoint; kept for parity with load scripts that append subsets.
    """
    parts = [df.filter(F.col(col) == F.lit(v)) for v in values]
    return reduce(DataFrame.unionByName, parts)


def rows_of_class(df: DataFrame, label: str, value: int) -> DataFrame:
    """Rows whose label equals ``value``."""
    return df.filter(F.col(label) == F.lit(value))


def label_from_status(col: str | Column, negatives: Sequence[str] = schemas.STATUS_NEGATIVE,
                      positives: Sequence[str] = schemas.STATUS_POSITIVE) -> Column:
    """Negatives -> 0, positives -> 1, anything else (and NULL) -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c.isin(list(negatives)), F.lit(0))
            .when(c.isin(list(positives)), F.lit(1))).cast("int")


def with_label(df: DataFrame, col: str = "SIT_CONVENIO", out: str = "TARGET", **kw) -> DataFrame:
    return df.withColumn(out, label_from_status(col, **kw))


def feature_variant(df: DataFrame, variant: str, agency: str | None = None,
                    agency_col: str = "COD_ORGAO_SUP") -> DataFrame:
    """One of the three feature-set variants, optionally one agency.

    The agency filter is applied before the agency columns are dropped.
    """
    if agency is not None:
        df = df.filter(F.col(agency_col) == F.lit(agency))
    return df.drop(*schemas.VARIANT_DROPS[variant])


def column_roles(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column lists from the schema; numeric first."""
    skip = set(exclude)
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return num, cat


# -- joins -------------------------------------------------------------------

def left_join_columns(left: DataFrame, right: DataFrame, key: str,
                      right_cols: Sequence[str]) -> DataFrame:
    """Every left column plus chosen right columns; unmatched rows kept.

    Duplicate keys on the right fan out exactly as a SQL LEFT JOIN does.
    Catalyst picks broadcast vs. sort-merge from statistics (AQE re-plans at
    runtime), so no hint is forced here.
    """
    r = right.select(F.col(key).alias("__k"), *[F.col(c) for c in right_cols])
    out = left.join(r, left[key] == r["__k"], "left")
    return out.select(*[left[c] for c in left.columns], *[r[c] for c in right_cols])


def count_matches(left: DataFrame, right: DataFrame, key: str, out: str) -> DataFrame:
    """J2/A1 (default mode): number of right rows per left key, 0 if none.

    The right side is aggregated *before* the join (map-side partial counts,
    so a key holding a third of all rows costs one partial row per task),
    and the left side is never regrouped.  Equal to "join then COUNT per
    agreement" whenever the agreement id is unique.
    """
    counts = right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")) \
        .agg(F.count(F.lit(1)).alias(out))
    j = left.join(counts, left[key] == counts["__k"], "left")
    return j.select(*[left[c] for c in left.columns],
                    F.coalesce(counts[out], F.lit(0)).cast("bigint").alias(out))


def count_matches_grouped(left: DataFrame, right: DataFrame, key: str, group: str,
                          out: str, tiebreak: str | None = None) -> DataFrame:
    """J2 compatibility mode: "LEFT JOIN, then COUNT per ``group``".

    The count of a group is the sum over its left rows of the number of
    right rows matching that row's key, so the right side is pre-counted per
    key and joined (no row fan-out even when one key holds a third of the
    right rows), then summed per group.  Columns not grouped take the values
    of one row of the group (smallest ``tiebreak``), the deterministic form
    of a loose GROUP BY (A2).
    """
    counts = right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")) \
        .agg(F.count(F.lit(1)).alias("__n"))
    j = left.join(counts, left[key] == counts["__k"], "left")
    cols = left.columns
    tb = tiebreak or group
    agg = j.groupBy(left[group].alias("__g")).agg(
        F.min_by(F.struct(*[left[c] for c in cols]), left[tb]).alias("__row"),
        F.coalesce(F.sum(counts["__n"]), F.lit(0)).alias(out),
    )
    return agg.select(*[F.col("__row")[c].alias(c) for c in cols], F.col(out).cast("bigint"))


def loose_group(df: DataFrame, key: str, tiebreak: str | Sequence[str]) -> DataFrame:
    """A2: one whole row per key (the row with the smallest tiebreak tuple).

    NULL keys form one group, as in SQL GROUP BY.  ``min_by`` is a partial
    aggregate, so a hot key is reduced map-side to one row per task.
    """
    cols = df.columns
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    order = F.struct(*[F.col(c) for c in tb]) if len(tb) > 1 else F.col(tb[0])
    agg = df.groupBy(F.col(key).alias("__g")).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__row"))
    return agg.select(*[F.col("__row")[c].alias(c) for c in cols])


def participants_distinct(left: DataFrame, members: DataFrame, key: str, member: str,
                          out: str) -> DataFrame:
    """J3/A3 default mode: distinct members per proposal, 0 if none.

    Two-level aggregation (distinct pairs, then counts) — both levels are
    partial-aggregated, so a hot proposal never lands whole in one task
    before it is reduced.
    """
    pairs = members.filter(F.col(key).isNotNull() & F.col(member).isNotNull()) \
        .select(key, member).distinct()
    counts = pairs.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias(out))
    j = left.join(counts, left[key] == counts["__k"], "left")
    return j.select(*[left[c] for c in left.columns],
                    F.coalesce(counts[out], F.lit(0)).cast("bigint").alias(out))


def pick_one_per_member(members: DataFrame, key: str, member: str) -> DataFrame:
    """A3 compatibility mode: each member is assigned to one proposal.

    A loose ``SELECT key ... GROUP BY member`` returns an arbitrary key per
    member; the smallest key is the deterministic choice.
    """
    return members.groupBy(member).agg(F.min(key).alias(key))


def participants_compat(left: DataFrame, members: DataFrame, key: str, member: str,
                        out: str) -> DataFrame:
    """J3 compatibility mode: count members assigned (A3 compat) to each proposal."""
    picked = pick_one_per_member(members, key, member).select(key)
    return count_matches(left, picked, key, out)


# -- aggregations, sorts -----------------------------------------------------

def class_balance(df: DataFrame, group: str, target: str = "TARGET") -> DataFrame:
    """A4: labelled rows, negatives and positives per group (NULL group kept)."""
    t = F.col(target)
    return df.groupBy(group).agg(
        F.count(t).alias("total"),
        F.sum(F.when(t == 0, 1).otherwise(0)).cast("bigint").alias("negativos"),
        F.sum(F.when(t == 1, 1).otherwise(0)).cast("bigint").alias("positivos"),
    )


def top_groups(report: DataFrame, group: str, n: int, by: str = "total") -> DataFrame:
    """O1/O2: first ``n`` groups by descending ``by`` (group value breaks ties).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own top ``n`` and only ``n`` rows per task reach the final merge.
    """
    return report.orderBy(F.col(by).desc(), F.col(group).asc_nulls_first()).limit(n)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: (column, value) for every distinct value of each column.

    All columns are stacked and de-duplicated in one aggregation (one
    shuffle, partial aggregation per task) rather than one per column.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return df.select(stack.alias("__p")).select("__p.column", "__p.value").distinct()
