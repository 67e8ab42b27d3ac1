"""Names for columns of our own beside those that a table has already."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with underscores in front until no column has it in either case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def own(df: DataFrame) -> list[Column]:
    """The table's columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
