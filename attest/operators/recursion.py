"""Recursive relations in SQL: each step is a job over the rows that the step before it made, and a recursion ends when a step makes none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Steps that a recursion may take. Those of this library end by themselves, each in as many steps as a group has members at most.
MOST_STEPS = 1_000_000


def recursive(spark: SparkSession, start: str, step: str, then: str, **tables: DataFrame) -> DataFrame:
    """`then`, SQL over the relation `walk` that `start` begins and `step` goes on with; tables are named in braces.

    Spark stops a recursion at a million rows unless told otherwise: that limit of the session is lifted, as tables may be of any size.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(f"WITH RECURSIVE walk MAX RECURSION LEVEL {MOST_STEPS} AS ({start} UNION ALL {step}) {then}", **tables)
