"""Delimited files whose quoted fields hold line breaks, read by many tasks.

A reader that starts in the middle of such a file can't tell whether a line
break there ends a record.  Three steps find out, none of which reads a file
in one task:

1. Each split of the text reader turns its lines into a function: given that
   the split starts outside or inside a quoted field, does it end outside or
   inside?  Lines without a quote change nothing.
2. The functions of a file's splits are composed in order.  A split that ends
   the same way whatever came before resets the state, others keep or turn it,
   so running counts over a row per split give the state at each start.
3. Each split cuts its lines into records.  What a split has of a record that
   begins before it or ends after it is a fragment; fragments of one record
   are put together in a grouped step that sees those rows only.

Step 3 needs the splits that start inside a field, 16 bytes each (13 MB for
100 TB in splits of 128 MB, if all did); nothing else is broadcast.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantrisk.session import cut_lineage

# Functions that run in Python workers are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ends_inside(line: str, inside: bool, sep: str = ";") -> bool:
    """Whether a line that starts inside a quoted field (or at the start of a record) ends inside one.

    A field is quoted if a quote is its first character; a doubled quote in it
    is a quote; after its closing quote everything up to the separator counts as text.
    """
    at, quoted = 0, re.compile(r'[^"]*+(?:""[^"]*+)*+')
    while True:
        if not inside:
            if line[at:at + 1] != '"':
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = quoted.match(line, at).end()
        if at >= len(line):
            return True
        inside = False
        at = line.find(sep, at + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, file, start): lines in order within each split of a file, the file as a hash of its path."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").alias("line"), F.xxhash64("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("start"))


def lines_are_records(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether every line of the files is a record to any reader: none holds a quote or a carriage return, none is blank."""
    line = F.col("line")
    odd = line.contains('"') | line.contains("\r") | ~line.rlike(r"[^\x00-\x20]")
    return not _lines(spark, path).agg(F.max(odd).alias("odd")).first()["odd"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.StringArray]]:
    """Consecutive lines of one split of a file."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(i).to_numpy() for i in (1, 2))
        edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for s, e in zip([0, *edges], [*edges, batch.num_rows]):
            yield int(file[s]), int(start[s]), batch.column(0).slice(s, e - s).cast(pa.string())


def _quoting(lines: pa.StringArray) -> tuple[list[int], list[str]]:
    """The lines that hold a quote: their places and texts."""
    places = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    return places.tolist(), lines.take(pa.array(places)).to_pylist()


def split_functions(spark: SparkSession, path: str | list[str], sep: str = ";") -> DataFrame:
    """(file, start, after_out, after_in): whether a split ends inside a quoted field, for either state at its start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bool]] = {}
        for file, start, lines in _runs(batches):
            state = held.setdefault((file, start), [False, True])
            for text in _quoting(lines)[1]:
                state[:] = [ends_inside(text, s, sep) for s in state]
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([held[k][0] for k in keys], pa.bool_()), pa.array([held[k][1] for k in keys], pa.bool_())],
            names=["file", "start", "after_out", "after_in"])

    return _lines(spark, path).mapInArrow(run, "file long, start long, after_out boolean, after_in boolean")


def split_states(functions: DataFrame) -> DataFrame:
    """``functions`` (see ``split_functions``) with ``inside``: whether the split starts inside a quoted field.

    The state at a start is what the last split before it that forgets its
    own start ended with (the start of the file, if there is none), turned
    as often as splits since then turn it.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("after_out") & ~F.col("after_in"), 1).otherwise(0)
    fixed = F.when(F.col("after_out") == F.col("after_in"), F.struct(F.col("after_out").alias("state"), F.col("turned")))
    counted = functions.withColumn("turned", F.sum(turns).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("reset", F.last(fixed, ignorenulls=True).over(before)) \
        .withColumn("so_far", F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0)))
    since = F.col("so_far") - F.coalesce(F.col("reset.turned"), F.lit(0))
    state = F.coalesce(F.col("reset.state"), F.lit(False))
    return counted.select("file", "start", "after_out", "after_in", (state != (since % 2 == 1)).alias("inside"))


_PARTS = T.StructType([T.StructField("record", T.StringType()), T.StructField("file", T.LongType()), T.StructField("start", T.LongType()),
                       T.StructField("opens", T.BooleanType()), T.StructField("closes", T.BooleanType()), T.StructField("lead", T.BooleanType())])


def _parts(lines: DataFrame, inside: set[tuple[int, int]], sep: str, fragments: bool) -> DataFrame:
    """Whole records (``opens`` and ``closes``), or the fragments, of every split; ``lead``: begins its file.

    A fragment that doesn't open a record is what a split has of one that
    began before it; one that doesn't close runs on into the next split.
    """
    held = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, opened, lead, rest = None, False, True, False, []

        def made(records: pa.Array, opens: list[bool], closes: list[bool], leads: list[bool]) -> pa.RecordBatch:
            keep = pa.array([(o and c) != fragments for o, c in zip(opens, closes)], pa.bool_())
            n = len(records)
            whole = [records, pa.array([now[0]] * n), pa.array([now[1]] * n), pa.array(opens), pa.array(closes), pa.array(leads)]
            return pa.RecordBatch.from_arrays([c.filter(keep) for c in whole], names=_PARTS.names)

        def unfinished() -> Iterator[pa.RecordBatch]:
            if rest:
                text = pa.array(["\n".join(t for r in rest for t in r.to_pylist())], pa.string())
                yield made(text, [opened], [False], [lead])

        for file, start, lines in _runs(batches):
            if (file, start) != now:
                yield from unfinished()
                now, state, rest = (file, start), (file, start) in held.value, []
                opened, lead = not state, start == 0
            ends = np.full(len(lines), not state)
            for at, text in zip(*_quoting(lines)):
                after = ends_inside(text, state, sep)
                if after != state:
                    state = after
                    ends[at:] = not after
            last = np.flatnonzero(ends)
            if not len(last):
                rest.append(lines)
                continue
            waiting = sum(map(len, rest))
            every = pa.concat_arrays([*rest, lines]) if rest else lines
            bounds = np.append(0, last + 1 + waiting)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), every)
            records = pc.binary_join(lists, "\n")
            n = len(records)
            yield made(records, [opened] + [True] * (n - 1), [True] * n, [lead] + [False] * (n - 1))
            opened, lead, tail = True, False, every.slice(int(bounds[-1]))
            rest = [tail] if len(tail) else []
        if now is not None:
            yield from unfinished()

    return lines.mapInArrow(run, _PARTS)


def read_records(spark: SparkSession, path: str | list[str], sep: str = ";", states: DataFrame | None = None, leads: bool = False) -> DataFrame:
    """(record, lead): every record of the files as text, quoted line breaks included; ``lead`` marks the first of a file.

    A file with a quote that is never closed ends in one record, as it does
    for a reader of the whole file (less a line break at the very end).  An
    empty file has no record.  ``states``: those of the splits, if at hand (see
    ``split_states``); ``leads``: only the first record of each file.
    """
    if states is None:
        states = cut_lineage(split_states(split_functions(spark, path, sep)))  # a row per split, read three times
    inside = {(r.file, r.start) for r in states.where("inside").select("file", "start").toLocalIterator()}
    lines = _lines(spark, path)
    whole = _parts(lines.where("start = 0") if leads else lines, inside, sep, fragments=False).select("record", "lead")
    whole = whole.where("lead") if leads else whole
    unclosed = states.groupBy("file").agg(F.max_by(F.when(F.col("inside"), F.col("after_in")).otherwise(F.col("after_out")), "start").alias("open"))
    if not inside and not unclosed.where("open").limit(1).collect():
        return whole
    parts = _parts(lines, inside, sep, fragments=True)
    # which record a fragment belongs to: numbers only, a row or two per split
    running = Window.partitionBy("file").orderBy("start", "opens").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.select("file", "start", "opens").withColumn("number", F.sum(F.col("opens").cast("long")).over(running))
    joined = parts.join(numbered, ["file", "start", "opens"]).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "opens", "record"))).alias("p"), F.max("lead").alias("lead"))
    text = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    return whole.unionByName((joined.where("lead") if leads else joined).select(text.alias("record"), "lead"))


def read_text_table(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> DataFrame:
    """All columns as strings, named by the header, like ``spark.read.csv`` with ``multiLine``, but from splits.

    ``options``: those of ``spark.read.csv``, with ``header`` true; quote and
    escape character must be ``"``.  Each file has a header.  Rows are the same but for one
    kind of broken field: where text follows a closing quote in a record's
    last field, the parser adds a quote at the end of its input.
    """
    if {options.get("quote", '"'), options.get("escape", '"')} != {'"'} or options.get("header") != "true":
        raise ValueError("files with a header, quoted and escaped by double quotes")
    columns = spark.read.options(**options, multiLine="true").csv(path).columns  # reads the header of one file only
    sep = options.get("sep", ",")
    states = cut_lineage(split_states(split_functions(spark, path, sep)))
    records = read_records(spark, path, sep, states)
    # as in a reader of whole files, the header tells how lines end
    crlf = read_records(spark, path, sep, states, leads=True).where(F.col("record").endswith("\r")).limit(1).count() > 0
    text = F.regexp_replace("record", "\r(\n|$)", "$1") if crlf else F.col("record")
    rows = records.where(~F.col("lead")).select(text.alias("record")).where("record <> ''")
    fields = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = F.from_csv("record", fields, {k: v for k, v in options.items() if k not in ("header", "encoding")} | {"multiLine": "true"})
    return rows.select(parsed.alias("r")).select(*[F.col("r").getField(f"c{i}").alias(c) for i, c in enumerate(columns)])

