"""Rules that are read again while a stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import rules as R
from ..sources.io import RuleFile


def scan_stream(texts: DataFrame, rules: RuleFile, write: Callable[[DataFrame, int], None], text_col: str = "text") -> DataStreamWriter:
    """A writer that scans each micro-batch with the rules as they stand in the file then and gives the batch to ``write``.

    A file that is missing or broken leaves the last good rules in force, as
    ``RuleFile`` says.  The caller starts the writer, with a checkpoint
    location; a batch that is repeated after a failure may meet newer rules.
    """

    def batch(df: DataFrame, number: int) -> None:
        write(R.scan(df, rules.get().active, text_col), number)

    return texts.writeStream.foreachBatch(batch)
