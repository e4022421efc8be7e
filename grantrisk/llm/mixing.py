"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words.  Complete epochs come first (each takes
every document of the source once); the rest of the budget is filled by a
weighted sample without replacement: document i gets the exponential key
-ln(u_i) / w_i, u_i from a hash of its id and w_i its quality weight, and the
documents are taken in ascending key order until their prefix sum of words
reaches the budget.  A document that straddles the budget is taken when over
half of it lies inside, so a source misses its target by half a document at
most.

No source is ever sorted as a whole: word counts are first summed per
(source, key bucket), and only the one bucket in which a source's budget ends
is sorted exactly.  The result is a cut-off key per source, against which
documents are compared in place, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

#: Key buckets per source: a source's budget ends in one of them, and only that one is sorted.
KEY_BUCKETS, BUCKETS_AN_E = 1 << 14, 1 << 10


def quality_weight(text: Column, least: float = 0.05) -> Column:
    """Share of letters among the characters that aren't spaces, at least ``least`` (also for NULL and empty texts)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.coalesce(F.greatest(F.when(solid > 0, letters / solid), F.lit(least)), F.lit(least))


def sampling_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits of the md5 of seed and id, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _item(id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
            sampling_key(F.col(id_col), quality_weight(text) if weight is None else weight, seed).alias("key")]


def items_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: int = 0, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, key) of every document: what the plan is made from.

    ``weight``: quality weight of a document, above 0 and not NULL (default
    ``quality_weight`` of its text).  Ids may be of any type that can be ordered.
    """
    return docs.select(*_item(id_col, text_col, source_col, seed, weight))


def source_targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0,
                   max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size) -> the same rows with ``target``.

    Sources in code point order (NULL last) weigh ``weights``, repeating, and
    share ``share`` of all words.  A target stops at ``max_epochs`` times its
    source; the excess goes to the others by weight until none is above, i.e.
    target = min(cap, level * weight) with one level for all.  A round of the
    search reads two sums of the (staged) source table.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = staged(sources.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_epochs))}), "sources")
    total = (src.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        held, free = src.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
                             F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - held) / free if free else level
        if not free or new <= level:
            break
        level = new
    return src.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _bucket(key: Column) -> Column:
    """Rises with the key, by its logarithm: whatever its weights, a source has at most 0.04 % of its keys in one bucket."""
    return F.least(F.floor(F.log1p(key * 4096) * BUCKETS_AN_E), F.lit(KEY_BUCKETS - 1)).cast("int")


def _place() -> Column:
    """A document's place in the order of keys and, for equal ones, ids, NULL first."""
    return F.struct(F.col("key").alias("key"), F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))


def plan_mix(items: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0,
             max_epochs: float = 3.0) -> DataFrame:
    """Per source: size, target, whole epochs, and the last (key, id) that the fractional epoch takes.

    ``items``: see ``items_of``; it is read twice, so pass a staged table.
    """
    items = items.withColumn("bucket", _bucket(F.col("key")))
    sums = staged(items.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    plan = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = staged(plan, "mix-targets")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    runs = sums.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "s")
    last = runs.join(plan, F.col("s").eqNullSafe(F.col("source"))) \
        .where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest"))) \
        .select("s", F.col("bucket").alias("last_bucket"), (F.col("upto") - F.col("words")).alias("before"), "rest")
    last = staged(last, "mix-last")
    inside = items.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("last_bucket")))
    ordered = Window.partitionBy("s").orderBy("key", F.asc_nulls_first("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(ordered) - F.col("size") / 2
    cuts = inside.withColumn("middle", middle).where("middle <= rest").groupBy(F.col("s").alias("c")) \
        .agg(F.max(_place()).alias("cut"))
    out = plan.join(last.select("s", "last_bucket"), F.col("source").eqNullSafe(F.col("s")), "left") \
        .join(cuts, F.col("source").eqNullSafe(F.col("c")), "left")
    return staged(out.select("source", "source_size", "target", "epochs", "last_bucket",
                             "cut"), "mix-plan")


def apply_mix(items: DataFrame, plan: DataFrame) -> DataFrame:
    """``items`` with source_size, target, ``copies`` (times the mix takes the document) and ``taken`` (its words).

    Every row stays.  Rows without words count as documents of size 0 and
    take nothing; NULL sources are one source.  Rows that share id and source
    share their key, hence their fate.  Other columns of ``items`` are kept.
    """
    p = plan.withColumnRenamed("source", "plan_source")
    joined = items.join(p, F.col("source").eqNullSafe(F.col("plan_source")))
    bucket, last = _bucket(F.col("key")), F.col("last_bucket")
    inside = F.col("cut").isNotNull() & F.coalesce(_place() <= F.col("cut"), F.lit(False))
    # Without a last bucket the rest of the budget holds all of the source, unless there is no rest.
    extra = F.when(last.isNull(), F.col("target") - F.col("epochs") * F.col("source_size") >= F.col("source_size")) \
        .when(bucket < last, True).when(bucket > last, False).otherwise(inside)
    copies = F.col("epochs") + F.coalesce(extra & (F.col("source_size") > 0), F.lit(False)).cast("int")
    out = joined.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.drop("plan_source", "epochs", "last_bucket", "cut")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_epochs: float = 3.0,
                seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``.

    Documents that the mix doesn't take go.  An empty table stays empty.
    ``weight``: see ``items_of``.
    """
    plan = plan_mix(staged(items_of(docs, id_col, text_col, source_col, seed, weight), "mix-items"), weights, share, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    items = docs.select(row, *_item(id_col, text_col, source_col, seed, weight))
    taken = apply_mix(items, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
