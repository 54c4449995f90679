"""Column-level helpers shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its exact name. Property names are arbitrary JSON keys,
    so ``user.id`` or ``a b`` must not be read as nested-field paths."""
    return F.col("`" + name.replace("`", "``") + "`")
