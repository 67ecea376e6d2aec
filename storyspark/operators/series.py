"""Ordered-series operators in grouped form: the series of many runs go through one Arrow batch; a run's series is bounded by its paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import series as S


def _grouped(rows: DataFrame, make: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``make`` of each key's rows (columns key, x and others, sorted by x), as columns after the key."""
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: pa.Table) -> pa.Table:
            out = make(part)
            n = len(next(iter(out.values())))
            return pa.table({"key": pa.repeat(part.column(0)[0], n) if n else pa.array([], part.schema.field(0).type)} | out)

        rest: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            rest = here if rest is None else pa.concat_tables([rest, here])
            if not len(rest):
                continue
            code = rest.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            ends = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()]
            if len(ends) > 1:
                yield from pa.concat_tables([made(rest.slice(i, j - i)) for i, j in zip(ends, ends[1:])]).combine_chunks().to_batches()
            rest = rest.slice(ends[-1])
        if rest is not None and len(rest):
            yield from made(rest).combine_chunks().to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "x").mapInArrow(run, f"key {kind}, {schema}")


def _values(part: pa.Table, name: str) -> np.ndarray:
    """A double column; null is NaN."""
    return part.column(name).to_numpy().astype(float)


def _points(points: DataFrame, key: str, x: str, y: str, **more) -> DataFrame:
    return points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[c.alias(n) for n, c in more.items()])


def curves(points: DataFrame, key: str, x: str, y: str, weight: str | None = None, bandwidth: float = 0.05, min_points: int = 5) -> DataFrame:
    """(key, x, y, smoothed): LOWESS per key; null values stay null."""

    def make(part: pa.Table) -> dict:
        xs, ys, ws = (_values(part, c) for c in ("x", "y", "w"))
        known = ~np.isnan(ys)
        smoothed = np.full(len(xs), np.nan)
        smoothed[known] = S.lowess(xs[known], ys[known], ws[known], bandwidth, min_points)
        return {"x": part.column("x"), "y": part.column("y"), "smoothed": pa.array(smoothed, mask=~known)}

    rows = _points(points, key, x, y, w=(F.col(weight) if weight else F.lit(1)).cast("double"))
    return _grouped(rows, make, "x double, y double, smoothed double").withColumnsRenamed({"key": key, "x": x, "y": y})


def downsample(points: DataFrame, key: str, x: str, y: str, budget: int = 200, must_keep: str | None = None) -> DataFrame:
    """The rows (key, x, y) that LTTB keeps, and rows whose ``must_keep`` is true and the first maximum."""

    def make(part: pa.Table) -> dict:
        must = [i for i, k in enumerate(part.column("keep").to_pylist()) if k]
        at = pa.array(S.sample_curve(part.column("y").to_pylist(), budget, must), pa.int64())
        return {c: part.column(c).take(at) for c in ("x", "y")}

    rows = _points(points, key, x, y, keep=F.col(must_keep) if must_keep else F.lit(False))
    return _grouped(rows, make, "x double, y double").withColumnsRenamed({"key": key, "x": x, "y": y})


def _per_key(points: DataFrame, key: str, x: str, y: str, make, schema: str) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(",")))
    types = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}

    def columns(part: pa.Table) -> dict:
        rows = make(part.column("x").to_pylist(), part.column("y").to_pylist())
        return {n: pa.array([r[i] for r in rows], types[k]) for i, (n, k) in enumerate(zip(names, kinds))}

    return _grouped(_points(points, key, x, y), columns, schema).withColumnRenamed("key", key)


def three_acts(points: DataFrame, key: str, x: str, y: str, conflict: str | None = None, flags: str | None = None) -> DataFrame:
    names = ("setup", "confrontation", "resolution", "climax")

    def make(part: pa.Table) -> dict:
        acts = S.three_acts(*(_values(part, c) for c in ("x", "y", "conflict", "flags"))) or dict.fromkeys(names)
        return {n: pa.array([acts[n]], pa.float64()) for n in names}

    count = lambda c: (F.col(c) if c else F.lit(0)).cast("double")
    rows = _points(points, key, x, y, conflict=count(conflict), flags=count(flags))
    return _grouped(rows, make, ", ".join(f"{n} double" for n in names)).withColumnRenamed("key", key)


def four_phases(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return _per_key(points, key, x, y, lambda xs, ys: S.four_phases(ys), "phase string, first_place int, last_place int")


def spaced_peaks(points: DataFrame, key: str, x: str, y: str, spacing: float = 0.05) -> DataFrame:
    return _per_key(points, key, x, y, lambda xs, ys: [(xs[i], ys[i]) for i in S.spaced_peaks(xs, ys, spacing)], "x double, y double")


def monotone_positions(points: DataFrame, key: str, x: str) -> DataFrame:
    return _per_key(points, key, x, x, lambda xs, ys: list(zip(xs, S.monotone(xs))), "x double, repaired double")
