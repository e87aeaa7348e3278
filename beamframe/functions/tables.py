"""Table functions, to be called in SQL over any table: groups of strips, clusters of grid hits.

    register_tables(spark)
    SELECT * FROM strip_groups(TABLE(strips), key => 'event', position => 'strip', charge => 'q', gap => 1)
    SELECT * FROM grid_clusters(TABLE(hits), key => 'event', x => 'x', y => 'y', energy => 'e', centre => 10.0)

Columns are named by arguments, so a function takes any table; its result has the key under its own name
and type. The functions ask for their rows partitioned by the key and in order themselves; a key's rows
are one event's, and one task holds them.

Defined cases: rows without a position or an energy are left out; a key may be null; a key without rows
that count gives none; names that the table lacks, or a key of no value, are errors of the call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _column(table: AnalyzeArgument, name: AnalyzeArgument | None, what: str) -> StructField:
    """The table's column that an argument names."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    if name is None or not isinstance(name.value, str):
        raise ValueError(f"{what} => has to name a column")
    for f in table.dataType.fields:
        if f.name.lower() == name.value.lower():
            return f
    raise ValueError(f"{what} => '{name.value}' is no column of {table.dataType.names}")


def _result(key: StructField, order: list[str], out: list[tuple[str, object]]) -> AnalyzeResult:
    schema = StructType([StructField(key.name, key.dataType), *(StructField(n, t) for n, t in out)])
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(n) for n in order])


class StripGroups:
    """Runs of neighbouring strips: key, first, n, total, centroid."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, position: AnalyzeArgument, charge: AnalyzeArgument, gap: AnalyzeArgument | None = None) -> AnalyzeResult:
        k, p, _ = _column(table, key, "key"), _column(table, position, "position"), _column(table, charge, "charge")
        return _result(k, [p.name], [("first", LongType()), ("n", LongType()), ("total", DoubleType()), ("centroid", DoubleType())])

    def __init__(self):
        self.key, self.run, self.last = None, [], None

    def _group(self) -> Iterator[tuple]:
        if self.run:
            at, q = np.array(self.run, float).T
            total = float(q.sum())
            yield self.key, int(at[0]), len(at), total, float((at * q).sum() / total) if total else float(at.mean())
        self.run = []

    def eval(self, row: Row, key: str, position: str, charge: str, gap: int = 1) -> Iterator[tuple]:
        values = {n.lower(): v for n, v in row.asDict().items()}
        at, q = values[position.lower()], values[charge.lower()]
        self.key = values[key.lower()]
        if at is not None and q is not None:
            if self.run and at - self.run[-1][0] > gap:
                yield from self._group()
            self.run.append((at, q))

    def terminate(self) -> Iterator[tuple]:
        yield from self._group()


class GridClusters:
    """Clusters of connected hits, split among their maxima: key, cluster, energy, x, y, n_blocks."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, x: AnalyzeArgument, y: AnalyzeArgument, energy: AnalyzeArgument, centre: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None, corners: AnalyzeArgument | None = None) -> AnalyzeResult:
        k, cx, cy, _ = _column(table, key, "key"), _column(table, x, "x"), _column(table, y, "y"), _column(table, energy, "energy")
        return _result(k, [cx.name, cy.name], [("cluster", LongType()), ("energy", DoubleType()), ("x", DoubleType()), ("y", DoubleType()), ("n_blocks", LongType())])

    def __init__(self):
        self.key, self.hits, self.cfg = None, {}, None

    def eval(self, row: Row, key: str, x: str, y: str, energy: str, centre: float = 10.0, least: float = 50.0, corners: bool = False) -> None:
        from beamframe.operators.clusters import IslandConfig

        values = {n.lower(): v for n, v in row.asDict().items()}
        self.key = values[key.lower()]
        self.cfg = self.cfg or IslandConfig(least_centre=float(centre), least_cluster=float(least), corners=corners)
        at, e = (values[x.lower()], values[y.lower()]), values[energy.lower()]
        if None not in at and e is not None and e > self.cfg.least_hit:
            self.hits[at] = self.hits.get(at, 0.0) + float(e)

    def terminate(self) -> Iterator[tuple]:
        from beamframe.operators.clusters import event_clusters

        if self.hits:
            hx, hy = np.array(list(self.hits)).T
            for k, r in enumerate(event_clusters(hx, hy, np.array(list(self.hits.values())), self.cfg)):
                yield self.key, k, *r


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("strip_groups", udtf(StripGroups))
    spark.udtf.register("grid_clusters", udtf(GridClusters))
