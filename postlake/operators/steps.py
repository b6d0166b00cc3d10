"""Plan shaping shared by the jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict) -> DataFrame:
    """Add or replace columns that are computed one time per row.

    Catalyst copies a projected expression into every filter above it, which
    would parse a JSON text again for each rule that reads it. It does not move
    anything through a generator, so the columns leave through one. They are made
    below it: a generator that holds a lambda runs all it holds without compiled code.
    """
    keep = [c for c in df.columns if c not in cols]
    made = F.struct(*[expr.alias(name) for name, expr in cols.items()]).alias("_made")
    return df.select(*keep, made).select(*keep, F.inline(F.array("_made")))
