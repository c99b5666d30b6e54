"""The movie a row belongs to: tables that carry ``dataset`` are worked on movie by movie, all in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

DATASET = "dataset"


def by(*tables: DataFrame) -> list[str]:
    """``["dataset"]`` where the tables carry that column, ``[]`` where none does.

    Every operator puts it before its own keys, so ids need to be unique in a movie
    only.  Tables with the column and tables without it do not go together: their
    rows could meet in the wrong movie.
    """
    carried = {DATASET in t.columns for t in tables}
    if len(carried) > 1:
        raise ValueError("some of the tables have a dataset column and some have none")
    return [DATASET] if carried == {True} else []
