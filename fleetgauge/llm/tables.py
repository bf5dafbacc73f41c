"""Input tables, session settings and Arrow helpers of the text queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 1000  # rows handed to Python at once; texts can be long


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_kinds(kinds: dict[str, str]) -> dict[str, pa.DataType]:
    fields = T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in kinds.items())).fields
    return {f.name: to_arrow_type(f.dataType) for f in fields}


def table_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def add_columns(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object]], kinds: dict[str, str], *needed: str
) -> DataFrame:
    """`df` with the columns that `work` makes of each Arrow batch; other columns pass unchanged.

    A column of `df` that has the name of a new one gives way to it, unless `work` needs it.
    """
    if clash := set(kinds) & set(needed):
        raise ValueError(f"input columns have the names of results: {sorted(clash)}")
    own = df.drop(*kinds)
    types = arrow_kinds(kinds)
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            new = [x if isinstance(x := made[k], pa.Array) else pa.array(x, t) for k, t in types.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *types])

    added = T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in kinds.items()))
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *added.fields]))


def null_safe(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """Join condition that also pairs nulls."""
    cond = F.lit(True)
    for a, b in pairs.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
