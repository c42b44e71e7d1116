"""Helpers of the operators: Arrow passes that keep columns, and components of links."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.sources.workdir import pinned

ROWS_AT_ONCE = 1024

# Executors need not have this package: its task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def travels(module: str) -> None:
    """Send the functions of ``module`` to the tasks by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def without(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` without columns that bear the name of a result column, in any case."""
    taken = {n.lower() for n in names}
    return frame.select([frame[f"`{c}`"] for c in frame.columns if c.lower() not in taken])


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.MapType)


def row_hash(frame: DataFrame, *more: Column) -> Column:
    """A hash of all columns of a row; maps, which Spark cannot hash, go in as JSON."""
    columns = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`")
        for f in frame.schema.fields
    ]
    return F.xxhash64(*columns, *more)


def boxed(frame: DataFrame) -> Column:
    """All columns of a row as one struct, out of the way of helper columns."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(frame.columns)])


def unboxed(names: list[str], box: str) -> list[Column]:
    return [F.col(box).getField(f"c{i}").alias(c) for i, c in enumerate(names)]


def per_text(
    frame: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[bytes | None], tuple]],
) -> DataFrame:
    """``frame`` with ``fields`` computed from the UTF-8 bytes of its text column.

    ``make`` is called once per task and gives the function of one text. Texts come in
    Arrow batches; one text is held at a time beside its batch.
    """
    names = [f.name for f in fields]
    kept = without(frame, *names)
    position = kept.columns.index(text)
    arrow = [pa.field(f.name, _arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values = batch.column(position).cast(pa.binary())
                rows = [one(value.as_py()) for value in values]
                made = [
                    pa.array([r[i] for r in rows], type=a.type) for i, a in enumerate(arrow)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *made], schema=pa.schema([*batch.schema, *arrow])
                )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def per_batch(
    frame: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[list]]],
    reads: list[str],
    carry: list[str] | None = None,
) -> DataFrame:
    """``frame`` with ``fields`` computed from batches of the columns that ``reads`` names.

    ``make`` is called once per task; its function gets at most ``ROWS_AT_ONCE`` rows
    and returns a list of values per field. Columns that bear the name of a field give
    way to it; all others, or those of ``carry``, come back as they are.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in (frame.columns if carry is None else carry) if c.lower() not in names]
    more = [c for c in reads if c not in kept]
    places = [kept.index(c) if c in kept else len(kept) + more.index(c) for c in reads]
    arrow = [pa.field(f.name, _arrow(f.dataType)) for f in fields]
    read = frame.select(
        *[frame[f"`{c}`"] for c in kept], *[frame[f"`{c}`"].alias(f"read {i}") for i, c in enumerate(more)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                back = batch.select(range(len(kept)))
                made = several(batch.select(places))
                yield pa.RecordBatch.from_arrays(
                    [*back.columns, *[pa.array(m, type=a.type) for m, a in zip(made, arrow)]],
                    schema=pa.schema([*back.schema, *arrow]),
                )

    return read.mapInArrow(run, T.StructType([*read.schema.fields[: len(kept)], *fields]))


def kept_in_worker(kind: str, key, make: Callable):
    """``make()``, kept in this Python worker for the tasks that follow.

    A worker holds one object per kind; another key replaces it.
    """
    kept = sys.__dict__.setdefault("_grievaline_kept", {})
    if kept.get(kind, (None,))[0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


class Recent(dict):
    """``make(key)`` by key, bounded: what was not asked for while ``size`` others came is forgotten.

    A key that is held is found without a call into Python, also through ``map``.
    """

    def __init__(self, size: int, make: Callable):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(),
        T.BooleanType(): pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return simple[kind]


def grouped_rows(
    batches: Iterator[pa.RecordBatch], n_keys: int
) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal leading columns out of batches that are sorted by them.

    Only the group that is being read is held.
    """
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        columns = [np.asarray(batch.column(i)) for i in range(n_keys)]
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            here = tuple(c[a].item() for c in columns)
            if held and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links (a, b)``; equal roots mean connected.

    Randomised contraction: each round every node follows the neighbour (or itself)
    that a round's hash puts first, which leaves at most some three quarters of the
    nodes in expectation, so the rounds grow with the logarithm of the links. Links
    shrink to distinct pairs of the remaining nodes; each round is written once. The
    hub of a large group is only the key of a minimum, which is combined before the
    shuffle. Empty links give no rows.
    """
    spark = links.sparkSession
    links = pinned(links.select("a", "b").where("a <> b"))
    steps: list[DataFrame] = []
    while not links.isEmpty():
        salt = F.lit(len(steps))
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.xxhash64("b", salt)
        own = F.xxhash64("a", salt)
        first = (
            ends.groupBy("a")
            .agg(F.min_by("b", order).alias("b"), F.min(order).alias("h"))
            .select(F.col("a").alias("node"), F.when(own < F.col("h"), F.col("a")).otherwise(F.col("b")).alias("root"))
        )
        first = pinned(first)
        steps.append(first)
        left = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = first.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = pinned(
            links.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = step.join(later, "root", "left").select(
            "node", F.coalesce("last", "root").alias("root")
        )
    return pinned(found)
