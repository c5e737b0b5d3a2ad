"""Change sets between a listing and the stored files, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def change_set(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """path, change: new, changed (other modification time), deleted or same."""
    old = stored.select("path", F.col("modified").alias("old"), F.lit(True).alias("was"))
    new = listed.select("path", F.col("modified").alias("new"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("is").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        .otherwise("same")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def apply_changes(stored: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of files that stayed the same, and the fresh rows of new and changed ones.

    Works for any frame with a `path`. `fresh` may hold rows of unchanged files; they
    are not used.
    """
    touched = changes.filter(F.col("change") != "same").select("path")
    wanted = changes.filter(F.col("change").isin("new", "changed")).select("path")
    return stored.join(touched, "path", "left_anti").unionByName(fresh.join(wanted, "path", "left_semi"))
