"""Layers whose failures stay in their own row: a detector that fails blocks its row, a generalisation that fails leaves the mask as it is."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from ..session import ship


def isolated(df: DataFrame, columns: list[str], layer: Callable[[list[tuple]], list], returns: str | DataType, out: str) -> DataFrame:
    """Adds ``out`` (value, error): what ``layer`` makes of rows (tuples of ``columns``), with failures kept to the rows that cause them.

    A batch goes through the layer at once; if that fails, each of its rows
    goes through it alone, and those that fail again get a null value and the
    kind of the failure, never its text, which may hold data.  A layer that
    gives another number of results than it got rows, or a result of another
    type, has failed.  The layer runs again for a lost task, so it should be
    one that may.
    """
    ship(df.sparkSession)
    kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns
    made = StructType([StructField("value", kind), StructField("error", _parse_datatype_string("string"))])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def tried(rows: list[tuple]) -> tuple[list, str | None]:
        try:
            values = layer(rows)
            if len(values) != len(rows):
                return [], "LengthError"
            return pa.array(values, arrow).to_pylist(), None
        except Exception as e:  # whatever a layer raises is its row's, not the job's
            return [], type(e).__name__

    @F.arrow_udf(made)
    def run(*given: pa.Array) -> pa.Array:
        rows = list(zip(*(g.to_pylist() for g in given), strict=True))
        values, error = tried(rows)
        told = [(v, None) for v in values] if error is None else []
        for row in rows if error is not None else ():
            one, wrong = tried([row])
            told.append((one[0] if wrong is None else None, wrong))
        return pa.array([{"value": v, "error": e} for v, e in told], pa.struct([("value", arrow), ("error", pa.string())]))

    # not to be copied: each row goes through the layer once
    return df.withColumn(out, run.asNondeterministic()(*(F.col(c) for c in columns)))


def block_failed(df: DataFrame, out: str, code: str, status: str = "status", reason: str = "reason_code") -> DataFrame:
    """A row whose layer failed is blocked with ``code``, unless it was blocked before."""
    failed = F.col(f"{out}.error").isNotNull()
    old = F.col(reason) if reason in df.columns else F.lit(None).cast("string")
    made = df.withColumn(reason, F.coalesce(old, F.when(failed, F.lit(code))))
    return made.withColumn(status, F.when(F.col(reason).isNull(), "ok").otherwise("blocked"))


def keep_failed(df: DataFrame, out: str, column: str) -> DataFrame:
    """``column`` takes the layer's value where it has one and stays where the layer failed or had nothing to say."""
    return df.withColumn(column, F.coalesce(F.col(f"{out}.value"), F.col(column)))
