"""Global ranks and running sums without a single-task window.

A window with ``ORDER BY`` but no (or a tiny) ``PARTITION BY`` sends every
row to one task.  Here the order key is first cut into ``n_buckets``
monotone buckets by a *deterministic* expression (never partition ids, which
can change when a lost task is recomputed):

1. per (group, bucket) totals — a tiny table, at most groups x buckets rows;
2. exclusive running totals over that tiny table, broadcast back (its size
   is bounded by the bucket count, not by the data);
3. a window partitioned by (group, bucket) adds the in-bucket running value.

The result equals the single-window result exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 64
MAX_BUCKETS = 1 << 17


def default_buckets(spark) -> int:
    """Buckets per group: at least 64, otherwise the session's shuffle
    partition count (so window parallelism grows with the cluster), capped so
    the broadcast offset table stays small (groups x 2^17 rows at most)."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "64"))
    except (TypeError, ValueError):
        n = DEFAULT_BUCKETS
    return max(DEFAULT_BUCKETS, min(n, MAX_BUCKETS))


def uniform_bucket(col: str | Column, n_buckets: int, upper: float) -> Column:
    """Bucket for a key known to be spread evenly on [0, upper)."""
    c = F.col(col) if isinstance(col, str) else col
    b = F.floor(c.cast("double") * F.lit(float(n_buckets)) / F.lit(float(upper)))
    return F.least(F.greatest(b, F.lit(0)), F.lit(n_buckets - 1)).cast("int")


def quantile_bucket(df: DataFrame, col: str, n_buckets: int | None = None,
                    descending: bool = False) -> DataFrame:
    """Add ``__bucket`` from approximate quantiles of ``col`` (equi-depth).

    Only ``n_buckets - 1`` cut points reach the driver.  NULLs go to bucket
    0 (ascending) or the last bucket (descending), i.e. they sort first/last
    consistently with ``asc_nulls_first``/``desc_nulls_last``.
    """
    n_buckets = n_buckets or default_buckets(df.sparkSession)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    accuracy = max(10000, 10 * n_buckets)
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("q")).first()["q"]
    splits = sorted({float(x) for x in (cuts or []) if x is not None})
    if not splits:  # one bucket (or no non-NULL values): nothing to cut
        return df.withColumn("__bucket", F.lit(0))
    splits = [float("-inf")] + splits + [float("inf")]
    nb = len(splits) - 1
    tmp = "__bkt_in"
    out = df.withColumn(tmp, F.col(col).cast("double"))
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol="__bkt_raw",
                     handleInvalid="keep").transform(out)
    b = F.when(F.col(tmp).isNull(), F.lit(0)).otherwise(F.col("__bkt_raw")).cast("int")
    if descending:
        b = F.when(F.col(tmp).isNull(), F.lit(nb - 1)).otherwise(F.lit(nb - 1) - F.col("__bkt_raw")).cast("int")
    return out.withColumn("__bucket", b).drop(tmp, "__bkt_raw")


def running_sums(df: DataFrame, order_by: Sequence[Column], sums: dict[str, Column],
                 bucket: Column | str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order_by`` order within ``partition_by``.

    ``bucket`` must be monotone non-decreasing in ``order_by`` (ties of the
    order key in one bucket).  ``order_by`` must be a total order (end it
    with a unique id) for the result to be deterministic.
    """
    bcol = F.col(bucket) if isinstance(bucket, str) else bucket
    parts = list(partition_by)
    d = df.withColumn("__b", bcol)
    for name, expr in sums.items():
        d = d.withColumn(f"__v_{name}", expr)
    totals = d.groupBy(*parts, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    wt = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "__b", *[
        F.coalesce(F.sum(f"__t_{n}").over(wt), F.lit(0)).alias(f"__o_{n}") for n in sums])
    # offsets has at most |groups| x n_buckets rows: safe to broadcast.
    on = F.col("__b") == F.col("__ob")
    for i, p in enumerate(parts):  # NULL is a group like any other
        offsets = offsets.withColumnRenamed(p, f"__g{i}")
        on = on & F.col(p).eqNullSafe(F.col(f"__g{i}"))
    offsets = offsets.withColumnRenamed("__b", "__ob")
    d = d.join(F.broadcast(offsets), on, "left").drop("__ob", *[f"__g{i}" for i in range(len(parts))])
    w = Window.partitionBy(*parts, "__b").orderBy(*order_by) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({n: F.sum(f"__v_{n}").over(w) + F.col(f"__o_{n}") for n in sums})
    return d.drop("__b", *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def row_number_global(df: DataFrame, order_by: Sequence[Column], bucket: Column | str,
                      partition_by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """1-based ``row_number()`` over (partition_by) ordered by ``order_by``."""
    return running_sums(df, order_by, {out: F.lit(1).cast("bigint")}, bucket, partition_by)


#: Buckets of a counting pass, and rows from which on the last bucket is counted again instead of being sorted.
DIGITS, FEW = 4096, 10000


def cuts_of_smallest(df: DataFrame, key: str, row_id: str, k: dict, group: str | None = None) -> dict:
    """Per group the (key, id) of the ``k[group]``-th smallest row by (key, id), without any order over all rows.

    Counting passes: the range of keys that holds the wanted row is cut into
    DIGITS buckets, whose counts (and least and greatest keys) are a small
    table; the bucket that it lies in is the next range.  Once that holds few
    rows, or one key only, these (or the ids of that key, counted the same
    way) settle it.  No task ever holds more than a bucket of FEW rows, so a
    key that a third of all rows share costs another pass, not a large sort.
    ``key`` and ``row_id`` are numbers without NULLs; ``df`` is read once a
    pass.  Groups with ``k`` 0 are left out.
    """
    groups = [g for g in k if k[g] > 0]
    rows = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(key).alias("key"), F.col(row_id).alias("id"))

    def of(g) -> Column:
        return F.col("g").isNull() if g is None else F.col("g") == F.lit(g)

    want = {g: k[g] for g in groups}
    held = dict.fromkeys(groups, F.lit(True))  # condition of the rows still in question
    done, column = {}, dict.fromkeys(groups, "key")
    known_key: dict = {}
    ranges = {r["g"]: r for r in rows.groupBy("g").agg(*[f(c).alias(n) for c in ("key", "id") for f, n in ((F.min, f"lo_{c}"), (F.max, f"hi_{c}"))],
                                                       F.count("*").alias("n")).collect()} if groups else {}
    low = {g: (ranges[g]["lo_key"], ranges[g]["hi_key"]) for g in groups}
    count = {g: ranges[g]["n"] for g in groups}
    while len(done) < len(groups):
        few = [g for g in groups if g not in done and count[g] <= FEW]
        for g in few:  # at most FEW rows each
            part = rows.filter(of(g) & held[g] & F.col(column[g]).between(*low[g])).select("key", "id").orderBy("key", "id").collect()
            done[g] = tuple(part[want[g] - 1])
        for g in [g for g in groups if g not in done and low[g][0] == low[g][1]]:
            if column[g] == "id":
                done[g] = (known_key[g], low[g][0])
                continue
            known_key[g], column[g] = low[g][0], "id"
            held[g] = F.col("key") == F.lit(low[g][0])
            r = rows.filter(of(g) & held[g]).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
            low[g] = (r["lo"], r["hi"])
        going = [g for g in groups if g not in done and low[g][0] != low[g][1]]
        if not going:
            continue
        bucket, inside = F.lit(None).cast("int"), F.lit(False)
        for g in going:
            lo, hi = low[g]
            x = F.col(column[g])
            mine = of(g) & held[g] & x.between(lo, hi)
            share = (x - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
            if hi - lo == math.inf:
                share = (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            place = F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1)).cast("int")
            bucket, inside = F.when(mine, place).otherwise(bucket), inside | mine
        value = F.lit(None)
        for g in going:
            value = F.when(of(g), F.col(column[g])).otherwise(value)
        found: dict = {g: [] for g in going}
        counted = rows.filter(inside).groupBy("g", bucket.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        for r in counted.collect():  # DIGITS rows a group
            found[r["g"]].append((r["b"], r["n"], r["lo"], r["hi"]))
        for g in going:
            for _, n, lo, hi in sorted(found[g]):
                if want[g] <= n:
                    low[g], count[g] = (lo, hi), n
                    break
                want[g] -= n
    return done


def among_smallest(key: Column, row_id: Column, cut: tuple | None) -> Column:
    """Whether a row's (key, id) is at most ``cut`` (see ``cuts_of_smallest``); False without one."""
    if cut is None:
        return F.lit(False)
    return (key < F.lit(cut[0])) | ((key == F.lit(cut[0])) & (row_id <= F.lit(cut[1])))
