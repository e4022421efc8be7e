"""Splits and class rebalancing.

* R1 stratified hold-out with exact per-class counts,
* R2 stratified k-fold with the unshuffled round-robin allocation,
* R7 class weights,
* R3 SMOTE, R4 NearMiss-1, R5 both, R6 the ratio x method plan.

Randomness is the portable ``mix(id, seed)`` hash, so a retried task (or
another engine) reproduces the same draw.  Per-class ranks use bucketed
running counts (:mod:`grantrisk.operators.ranking`) instead of a window
partitioned only by the label, which would put each class in one task.

Neighbour search (R3/R4) is that of :mod:`grantrisk.operators.neighbours`.
Rows may be arrays or Spark ML vectors; vectors stay sparse throughout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantrisk import schemas
from grantrisk.functions.scalar import MIX_RANGE, mix, uniform01
from grantrisk.operators import neighbours, ranking
from grantrisk.session import cut_lineage

# Reference rows that a task of the neighbour search holds (bytes, estimated).
MAX_BLOCK_BYTES = 8 * 1024 * 1024
# Stands for a NULL id in the order of ids, where NULL comes first.
LEAST_ID = -(1 << 63)


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class (one row per class reaches the driver)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def minority_class(counts: dict, minority=None):
    """The given minority label, or the smallest class (ties: smaller label)."""
    if minority is not None:
        return minority
    return min(counts, key=lambda c: (counts[c], _null_last(c)))


def _null_last(c) -> tuple:
    return (c is None, 0 if c is None else c)


class InfeasibleRatio(ValueError):
    """The ratio asks a resampler for rows that it can't make."""


# -- R1 -------------------------------------------------------------------------

def holdout_counts(counts: dict, test_share: float) -> dict:
    """Rows per class in the test part of a stratified split.

    ``n_test = ceil(share x n)``; the training part gets ``floor(n_c x
    n_train / n)`` rows per class plus one for the classes with the largest
    remainders (ties: smaller label) until it holds ``n_train`` rows; the
    test part takes the rest of each class.
    """
    n = sum(counts.values())
    if n == 0:
        return {}
    n_test = math.ceil(test_share * n)
    n_train = n - n_test
    cont = {c: v * n_train / n for c, v in counts.items()}
    train = {c: math.floor(x) for c, x in cont.items()}
    need = n_train - sum(train.values())
    for c in sorted(cont, key=lambda c: (-(cont[c] - train[c]), _null_last(c)))[:need]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def holdout_split(df: DataFrame, label: str = "label", row_id: str = "row_id",
                  test_share: float = schemas.HOLDOUT_SHARE, seed: int = schemas.SEED,
                  n_buckets: int | None = None) -> DataFrame:
    """Adds ``split`` = 'test' / 'train' with exact per-class counts.

    Rows are ordered inside each class by ``mix(id, seed)`` then id; the
    first :func:`holdout_counts` rows of each class form the test part.
    """
    k = holdout_counts(class_counts(df, label), test_share)  # one entry per class
    d = df.withColumn("__mix", mix(row_id, seed))
    if isinstance(df.schema[row_id].dataType, T.IntegralType):
        # every counting pass reads these three columns; the hash of an id costs more than a pass
        keys = cut_lineage(d.select(F.col(label).alias("label"), F.coalesce(row_id, F.lit(LEAST_ID)).alias("id"), "__mix"))
        cuts = ranking.cuts_of_smallest(keys, "__mix", "id", k, "label")
        is_test = F.lit(False)
        for c in k:
            cond = F.col(label).isNull() if c is None else (F.col(label) == F.lit(c))
            is_test = F.when(cond, ranking.among_smallest(F.col("__mix"), F.coalesce(row_id, F.lit(LEAST_ID)), cuts.get(c))).otherwise(is_test)
        return d.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("__mix")
    # ids of other types are ranked in buckets
    n_buckets = n_buckets or ranking.default_buckets(df.sparkSession)
    d = ranking.row_number_global(d, [F.col("__mix"), F.col(row_id)],
                                  ranking.uniform_bucket("__mix", n_buckets, MIX_RANGE), [label], out="__rn")
    limit = F.lit(0)
    for c, n_c in k.items():
        cond = F.col(label).isNull() if c is None else (F.col(label) == F.lit(c))
        limit = F.when(cond, F.lit(n_c)).otherwise(limit)
    is_test = F.col("__rn") <= limit
    return d.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("__mix", "__rn")


# -- R2 -------------------------------------------------------------------------

def stratified_folds(df: DataFrame, label: str = "label", row_id: str = "row_id",
                     k: int = schemas.N_FOLDS, out: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """R2: unshuffled stratified k-fold assignment (contiguous blocks per class).

    Classes are numbered by first appearance (row-id order).  Sorting all
    labels by that number and dealing them round-robin into k folds gives
    the number of rows of each class per fold; inside a class, rows in id
    order fill fold 0 first, then fold 1, ...  The per-(class, fold) bounds
    form a table of classes x k rows, joined back on the class.
    """
    spark = df.sparkSession
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))
    rows = sorted(cls.collect(), key=lambda r: (r["first"], str(r[label])))  # one row per class
    bounds = []
    start = 0
    for r in rows:
        n_c = r["n"]
        lo = 0
        for f in range(k):
            # positions p in [start, start+n_c) with p % k == f
            cnt = (start + n_c - 1 - f) // k - (start - 1 - f) // k
            bounds.append((r[label], f, lo, lo + cnt))
            lo += cnt
        start += n_c
    btab = spark.createDataFrame(bounds, f"{label} {dict(df.dtypes)[label]}, {out} int, lo long, hi long")
    d = _rank_by_id(df, row_id, [label], "__rn", n_buckets)
    d = d.withColumn("__r", F.col("__rn") - 1)
    # classes x k rows: bounded; equi-join on the class plus a range test
    j = d.join(F.broadcast(btab), d[label].eqNullSafe(btab[label]) & (d["__r"] >= btab["lo"]) & (d["__r"] < btab["hi"]))
    return j.select(*[d[c] for c in df.columns], btab[out])


def _rank_by_id(df: DataFrame, row_id: str, partition_by: Sequence[str] = (), out: str = "__rn",
                n_buckets: int | None = None) -> DataFrame:
    """1-based rank by ``row_id`` (per partition) with equi-depth id buckets,
    so clustered ids never concentrate in one window task."""
    d = ranking.quantile_bucket(df, row_id, n_buckets)
    return ranking.row_number_global(d, [F.col(row_id)], "__bucket", partition_by, out=out).drop("__bucket")


# -- R7 -------------------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced",
                  pos_weight: float = schemas.DEFAULT_POS_WEIGHT, out: str = "weight") -> DataFrame:
    """``balanced`` -> n / (n_classes x n_c); ``pos`` -> pos_weight for 1, 1 otherwise."""
    if mode == "pos":
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
    counts = class_counts(df, label)  # one row per class
    n, n_cls = sum(counts.values()), len(counts)
    w = None
    for c, n_c in counts.items():
        cond = F.col(label).isNull() if c is None else (F.col(label) == F.lit(c))
        val = F.lit(n / (n_cls * n_c))
        w = F.when(cond, val) if w is None else w.when(cond, val)
    return df.withColumn(out, w)


# -- k nearest neighbours ------------------------------------------------------

def _as_double(vec: str) -> Column:
    return F.transform(F.col(vec), lambda x: x.cast("double"))


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def _knn_sql(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, chunk_rows: int) -> DataFrame:
    """The same lists with higher-order functions, each size-checked chunk of references as one value: for checks on small data."""
    n_chunks = max(1, math.ceil(r.count() / chunk_rows))
    r = _rank_by_id(r, "rid", out="__rn").withColumn("chunk", ((F.col("__rn") - 1) / F.lit(chunk_rows)).cast("int"))
    lists = []
    for c in range(n_chunks):
        packed = r.filter(F.col("chunk") == c).agg(F.collect_list(F.struct("rid", "rvec")).alias("refs"))
        dists = F.transform("refs", lambda e: F.struct(_sqdist(F.col("qvec"), e["rvec"]).alias("d2"), e["rid"].alias("id")))
        if exclude_self:
            dists = F.filter(dists, lambda s: s["id"] != F.col("qid"))
        lists.append(q.withColumn("refs", packed.select("refs").scalar()).select("qid", dists.alias("nn")))
    out = lists[0]
    for part in lists[1:]:
        out = out.unionByName(part)
    return neighbours.best(out, k)


def is_vector(df: DataFrame, col: str) -> bool:
    """Whether a column holds Spark ML vectors."""
    return isinstance(df.schema[col].dataType, VectorUDT)


def knn(queries: DataFrame, refs: DataFrame, k: int, row_id: str = "row_id", vec: str = "embedding",
        exclude_self: bool = False, max_bytes: int = MAX_BLOCK_BYTES, engine: str = "numpy",
        recall: float | None = None) -> DataFrame:
    """k nearest ``refs`` of every query row, exact unless a ``recall`` is given.

    Returns (row_id, nn) where ``nn`` is an array of (d2, id) structs sorted by
    squared distance then id (ties broken by the smaller id).  ``vec``: arrays,
    or Spark ML vectors, which stay sparse.  ``max_bytes`` bounds the
    reference rows of a part; a task holds parts of ``neighbours.SHELF_BYTES``
    together, or one larger part.  ``recall``: the share of true
    neighbours that is enough (see :mod:`grantrisk.operators.neighbours`).
    ``engine="sql"`` compares every pair of arrays in the JVM and gives the
    same lists.  NULL vectors, NULL components and arrays of another length
    are an error.
    """
    first = refs.select(vec).first()
    if first is None:  # no reference rows: every query gets an empty list
        return queries.select(F.col(row_id), F.array().cast(neighbours.EMPTY).alias("nn"))
    sparse = is_vector(refs, vec)
    columns = neighbours.sparse_columns(vec) if sparse else [_as_double(vec).alias("vec")]
    r = refs.select(F.col(row_id).cast("bigint").alias("rid"), *columns)
    q = queries.select(F.col(row_id).cast("bigint").alias("qid"), *columns)
    if sparse:  # 12 bytes a component, their mean number from all rows
        size = 12 * (r.agg(F.avg(F.size("index"))).first()[0] or 0.0)
    else:
        size = 8 * len(first[vec] or [])
    rows = max(1, int(max_bytes // (size + 48)))
    if engine == "sql":
        found = _knn_sql(q.withColumnRenamed("vec", "qvec"), r.withColumnRenamed("vec", "rvec"), k, exclude_self, rows)
    else:
        found = neighbours.search(q, r, k, exclude_self, rows, recall)
    out = q.select("qid").join(found, "qid", "left") \
        .select(F.col("qid").alias(row_id), F.coalesce("nn", F.array().cast(neighbours.EMPTY)).alias("nn"))
    return out.withColumn(row_id, F.col(row_id).cast(dict(queries.dtypes)[row_id]))


def between(a: str, b: str, step: str, width: int) -> Column:
    """The point ``a`` + ``step`` x (``b`` - ``a``) of two Spark ML vectors of ``width`` components, sparse.

    One small object per synthetic row: Spark has no function that makes a
    sparse vector from lists.
    """
    def mixed(x, y, u):
        values = dict(zip(x.indices.tolist(), x.values.tolist())) if hasattr(x, "indices") else dict(enumerate(x.toArray().tolist()))
        other = dict(zip(y.indices.tolist(), y.values.tolist())) if hasattr(y, "indices") else dict(enumerate(y.toArray().tolist()))
        out = {}
        for i in sorted({*values, *other}):
            v = values.get(i, 0.0)
            out[i] = v + u * (other.get(i, 0.0) - v)
        return Vectors.sparse(width, {i: v for i, v in out.items() if v})

    return F.udf(mixed, VectorUDT())(a, b, step)


# -- R3 SMOTE ---------------------------------------------------------------------

def smote_count(n_major: int, n_minor: int, ratio: float) -> int:
    """Synthetic rows needed so that minority / majority reaches ``ratio``."""
    n_new = int(n_major * ratio - n_minor)
    if n_new < 0:
        raise InfeasibleRatio(f"ratio {ratio} would remove minority rows "
                         f"({n_minor} minority vs {n_major} majority already)")
    return n_new


def smote(df: DataFrame, ratio: float, label: str = "label", row_id: str = "row_id",
          vec: str = "embedding", k: int = schemas.SMOTE_K, seed: int = schemas.SEED,
          minority: int | None = None, recall: float | None = None) -> DataFrame:
    """Append synthetic minority rows x + u (nb - x), nb one of the k
    nearest minority rows of x.

    Sample j (0-based) draws ``idx = mix(j, seed) mod (n_min k)``: base =
    minority row of rank idx div k (id order), neighbour = its (idx mod k)-th
    nearest; ``u = uniform01(j, seed + 1)``.  Output: original rows plus new
    rows (negative ids), with ``synthetic``, ``base_id``, ``neighbour_id``,
    ``step`` columns.
    """
    spark: SparkSession = df.sparkSession
    counts = class_counts(df, label)
    minority = minority_class(counts, minority)
    n_min = counts.get(minority, 0)
    n_maj = max(v for c, v in counts.items() if c != minority)
    n_new = smote_count(n_maj, n_min, ratio)
    base = df.select(row_id, label, F.col(vec).alias(vec), F.lit(False).alias("synthetic"),
                     F.lit(None).cast("bigint").alias("base_id"),
                     F.lit(None).cast("bigint").alias("neighbour_id"),
                     F.lit(None).cast("double").alias("step"))
    sparse = is_vector(df, vec)
    if not sparse:
        base = base.withColumn(vec, _as_double(vec))
    if n_new == 0 or n_min == 0:
        return base
    kk = min(k, n_min - 1)
    if kk < 1:
        raise InfeasibleRatio("SMOTE needs at least two minority rows")
    mino = df.filter(F.col(label) == minority).select(row_id, vec)
    ranked = _rank_by_id(mino, row_id, out="__rank")
    nn = cut_lineage(knn(mino, mino, kk, row_id, vec, exclude_self=True, recall=recall))
    info = ranked.join(nn, on=[row_id]).select(
        (F.col("__rank") - 1).alias("__b"), F.col(row_id).alias("base_id"),
        (F.col(vec) if sparse else _as_double(vec)).alias("__x"), F.col("nn"))
    j = spark.range(n_new).select(F.col("id").alias("__j"))
    j = j.withColumn("__idx", F.pmod(mix("__j", seed), F.lit(n_min * kk))) \
         .withColumn("__b", (F.col("__idx") / F.lit(kk)).cast("bigint")) \
         .withColumn("__c", F.pmod(F.col("__idx"), F.lit(kk)).cast("int")) \
         .withColumn("step", uniform01("__j", seed + 1))
    s = j.join(info, on="__b").withColumn("neighbour_id", F.element_at("nn", F.col("__c") + 1)["id"])
    nbv = mino.select(F.col(row_id).alias("neighbour_id"), (F.col(vec) if sparse else _as_double(vec)).alias("__nb"))
    s = s.join(nbv, on="neighbour_id")
    if sparse:
        point = between("__x", "__nb", "step", mino.select(F.unwrap_udt(vec)["size"]).first()[0] or len(mino.select(vec).first()[0]))
    else:
        point = F.zip_with("__x", "__nb", lambda a, b: a + F.col("step") * (b - a))
    new = s.select((-(F.col("__j") + 1)).cast(dict(df.dtypes)[row_id]).alias(row_id),
                   F.lit(minority).cast(dict(df.dtypes)[label]).alias(label),
                   point.alias(vec),
                   F.lit(True).alias("synthetic"), F.col("base_id").cast("bigint"),
                   F.col("neighbour_id").cast("bigint"), F.col("step"))
    return base.unionByName(new)


# -- R4 NearMiss-1 ------------------------------------------------------------------

def nearmiss_keep(n_major: int, n_minor: int, ratio: float) -> int:
    n_keep = int(n_minor / ratio)
    if n_keep > n_major:
        raise InfeasibleRatio(f"ratio {ratio} would need new majority rows "
                         f"({n_keep} requested, {n_major} present)")
    return n_keep


def nearmiss(df: DataFrame, ratio: float, label: str = "label", row_id: str = "row_id",
             vec: str = "embedding", k: int = schemas.NEARMISS_K, minority: int | None = None,
             recall: float | None = None) -> DataFrame:
    """Keep the majority rows with the smallest mean distance to their k
    nearest minority rows (ties: smaller id), until minority/majority = ratio.

    Adds ``mean_dist`` (NULL for minority rows).
    """
    counts = class_counts(df, label)
    minority = minority_class(counts, minority)
    n_min = counts.get(minority, 0)
    n_maj = max(v for c, v in counts.items() if c != minority)
    n_keep = nearmiss_keep(n_maj, n_min, ratio)
    mino = df.filter(F.col(label) == minority)
    majo = df.filter(F.col(label) != minority)
    nn = knn(majo, mino, k, row_id, vec, recall=recall)
    md = nn.select(row_id, (F.aggregate(F.transform("nn", lambda e: F.sqrt(e["d2"])), F.lit(0.0),
                                        lambda a, x: a + x) / F.size("nn")).alias("mean_dist"))
    # The neighbour search runs once: the counting passes and the selection read the checkpointed distances.
    md = cut_lineage(md)
    cut = ranking.cuts_of_smallest(md, "mean_dist", row_id, {0: n_keep}).get(0)
    keep = md.filter(ranking.among_smallest(F.col("mean_dist"), F.col(row_id), cut))
    kept = majo.join(keep, on=[row_id])
    out = mino.withColumn("mean_dist", F.lit(None).cast("double")).unionByName(kept)
    return out if is_vector(df, vec) else out.withColumn(vec, _as_double(vec))


# -- R5 / R6 ------------------------------------------------------------------------

def smote_nearmiss(df: DataFrame, ratio: float, **kw) -> DataFrame:
    """SMOTE then NearMiss, both at ``ratio``."""
    s = cut_lineage(smote(df, ratio, **kw))  # NearMiss reads it several times
    nm_kw = {k_: v for k_, v in kw.items() if k_ in ("label", "row_id", "vec", "minority", "recall")}
    return nearmiss(s.drop("mean_dist") if "mean_dist" in s.columns else s, ratio, **nm_kw)


def resample(df: DataFrame, method: str, ratio: float, **kw) -> DataFrame:
    if method == "smote":
        return smote(df, ratio, **kw)
    if method == "nearmiss":
        nm_kw = {k_: v for k_, v in kw.items() if k_ in ("label", "row_id", "vec", "minority", "recall")}
        return nearmiss(df, ratio, **nm_kw)
    if method == "smote_nearmiss":
        return smote_nearmiss(df, ratio, **kw)
    raise ValueError(f"unknown resampler {method!r}")


def resample_plan(df: DataFrame, ratios: Sequence[float], methods: Sequence[str] = ("smote", "nearmiss",
                                                                                    "smote_nearmiss"),
                  label: str = "label", **kw) -> DataFrame:
    """Class counts after each (method, ratio) of the plan; infeasible
    combinations are reported with ``error`` instead of rows."""
    spark = df.sparkSession
    parts = []
    for m in methods:
        for r in ratios:
            try:
                out = resample(df, m, r, label=label, **kw)
                parts.append(out.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
                             .select(F.lit(m).alias("method"), F.lit(float(r)).alias("ratio"),
                                     F.col(label).cast("int").alias("label"), "n",
                                     F.lit(None).cast("string").alias("error")))
            except InfeasibleRatio:
                parts.append(spark.createDataFrame(
                    [(m, float(r), None, None, "infeasible")],
                    "method string, ratio double, label int, n long, error string"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
