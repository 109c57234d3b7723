"""Computing a costly expression once per row.

Catalyst merges neighbouring projections and copies an expression to every place that uses its
column; what runs outside generated code is then computed again each time. A generator is not merged,
so its output columns are computed once, still inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """The name, or that with underscores before it, such that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added or replaced."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly; for the aggregated side of a join on its grouping key.

    Without it the aggregate's own partitioning serves the join, and AQE can't split the partition of a
    hot key on the other side, as it does between two plain exchanges. The aggregate is the small side.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def widen(df: DataFrame) -> DataFrame:
    """df, dealt out if it has fewer partitions than the cluster has cores; for work on texts that dwarfs moving them.

    A table of many files is never moved. Only for plans without a shuffle, whose partitions are known.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
