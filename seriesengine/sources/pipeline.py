"""A whole ingest in one call: gate, parse, merge, save, record."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.schemas import INGEST_STATE
from seriesengine.sources.ingest import due_for_ingest, record_ingest
from seriesengine.sources.tables import merge_table, read_table, replace_table


def ingest(
    source: str, landed: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, state_path: str, now: datetime,
    *, on: Sequence[str], cell: Column, order_by: Sequence[str] = (), max_age: str = "6 hours",
) -> bool:
    """Merge the rows that ``parse`` makes of ``landed`` into the table at ``path``; stored rows win.

    Nothing is done, and False returned, if ``source`` was ingested less than ``max_age`` before
    ``now``, by the state table at ``state_path``. The time is recorded after the merge, so a failure
    in between leaves the source due; its repetition finds the rows already stored and adds none.
    """
    spark = landed.sparkSession
    state = read_table(spark, state_path, INGEST_STATE)
    mine = state.where(F.col("source") == source)
    if not mine.isEmpty() and due_for_ingest(mine, F.lit(now), max_age).isEmpty():
        return False
    merge_table(parse(landed), path, on, order_by, cell=cell)
    replace_table(record_ingest(state, source, now), state_path)
    return True
