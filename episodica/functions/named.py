"""Functions that SQL text can call by name once ``register`` has run on a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from episodica.operators.scan import hysteresis_step

#: Name, parameters, type and body of the SQL functions; they are inlined, so nothing leaves the JVM.
SQL_FUNCTIONS = (
    ("iou", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", """
        try_divide(greatest(least(a[2], b[2]) - greatest(a[0], b[0]), 0D) * greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0D),
            (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
            - greatest(least(a[2], b[2]) - greatest(a[0], b[0]), 0D) * greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0D))"""),
    ("quat_mul", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", """
        array(a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
              a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])"""),
    ("quat_inv", "q ARRAY<DOUBLE>", "ARRAY<DOUBLE>", """
        transform(array(q[0], -q[1], -q[2], -q[3]), x -> x / (q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]))"""),
    ("upper_median", "xs ARRAY<DOUBLE>", "DOUBLE", "try_element_at(array_sort(array_compact(xs)), int(size(array_compact(xs)) / 2) + 1)"),
)


@udtf(returnType="group string, start long, end long")
class HysteresisRuns:
    """Rows (group, place, value, span) of one group in order: where it closes, and where it opens again or null."""

    def __init__(self) -> None:
        self.state, self.start, self.group = ("above", float("-inf")), None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.group = row[0]
        self.state, (event,) = hysteresis_step(self.state, row[2], row[3])
        if event == "close":
            self.start = row[1]
        elif event == "open":
            yield self.group, self.start, row[1]
            self.start = None

    def terminate(self) -> Iterator[tuple]:
        if self.start is not None:
            yield self.group, self.start, None


@udtf(returnType="group string, start long, end long")
class MergeRuns:
    """Rows (group, start, end, gap) of one group in order: runs with fewer than ``gap`` places between them become one."""

    def __init__(self) -> None:
        self.now: tuple | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        group, start, end, gap = row
        if self.now is not None and start - self.now[2] < gap:
            self.now = (group, self.now[1], max(self.now[2], end))
        else:
            if self.now is not None:
                yield self.now
            self.now = (group, start, end)

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield self.now


def register(spark: SparkSession) -> None:
    """Make iou, quat_mul, quat_inv, upper_median, and the table functions hysteresis_runs and merge_runs known to SQL.

    Table functions take ``TABLE(...) PARTITION BY ... ORDER BY ...``; a partition is read in order, row by row.
    """
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("hysteresis_runs", HysteresisRuns)
    spark.udtf.register("merge_runs", MergeRuns)
