"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array: str | Column, *names: str) -> DataFrame:
    """Rows of an array column, with one name for the element or two for position and element.

    The outer form is deliberate.  An inner explode makes the optimizer test
    for empty arrays first, and that test moves below the projections, where it
    computes the whole array expression a second time (and the texts it reads
    many times over).  Here empty arrays are dropped after they were made once.
    """
    array = F.expr(array) if isinstance(array, str) else array
    pos, element = names if len(names) == 2 else ("_pos", names[0])
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, element)).filter(F.col(pos).isNotNull())
    return out if len(names) == 2 else out.drop(pos)


def made_rows(df: DataFrame, keep: list, value: str, name: str) -> DataFrame:
    """Rows whose ``value`` is not NULL, with it as ``name``.

    A plain filter on a computed column moves below projections, ``distinct``
    and ``repartition``: there the whole expression runs once more, over the
    texts it is made of, and in the few tasks that read a small table.
    """
    return df.transform(explode_rows, keep, f"filter(array({value}), made -> made IS NOT NULL)", name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few bytes, much work: rows dealt by key to as many tasks as a shuffle has, not to as few as their bytes would need."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
