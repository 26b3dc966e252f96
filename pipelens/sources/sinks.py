"""Writers of the result tables. None writes over or into an input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _guard(target: str, inputs: list[str]) -> None:
    norm = lambda p: p.rstrip("/")
    for path in inputs:
        if norm(target) == norm(path) or norm(target).startswith(norm(path) + "/"):
            raise ValueError(f"{target} is an input or lies in one")


def archive(found: DataFrame, target: str, inputs: list[str] = ()) -> None:
    """All findings as Parquet by category."""
    _guard(target, list(inputs))
    found.write.partitionBy("category").mode("overwrite").parquet(target)


def archive_csv(found: DataFrame, target: str, inputs: list[str] = ()) -> None:
    """All findings as semicolon CSV."""
    _guard(target, list(inputs))
    found.write.mode("overwrite").option("sep", ";").option("header", True).csv(target)


def layer(objects: DataFrame, target: str, inputs: list[str] = ()) -> None:
    """Objects with a point as Parquet with a well-known text column."""
    _guard(target, list(inputs))
    text = F.when(F.col("x").isNotNull(), F.concat(F.lit("POINT ("), F.col("x"), F.lit(" "), F.col("y"), F.lit(")")))
    objects.withColumn("geometry", text).write.mode("overwrite").parquet(target)
