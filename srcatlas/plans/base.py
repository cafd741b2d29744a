"""Current rows of the repository tables, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ordinals as ranked  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of files with an id, with what `latest` orders them by."""
    return read(spark, sf_dir, "files").filter("id IS NOT NULL").withColumns({"_at": F.col("ingested_at"), "_tie": F.col("hash")})


def latest(df: DataFrame) -> DataFrame:
    """The latest row of each id; of rows of the same time the one with the greatest hash."""
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last("_at"), F.desc_nulls_last("_tie"))
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_at", "_tie")


def files(spark: SparkSession, sf_dir: str, *cols: str, **made: Column) -> DataFrame:
    """The latest row of each file id, with the columns asked for and those made from its row.

    What is made is computed before rows are exchanged: a result made of the content travels, the content doesn't.
    """
    names = [c for c in dict.fromkeys(["id", *cols]) if c not in made]
    return latest(versions(spark, sf_dir).select(*names, "_at", "_tie", *[e.alias(n) for n, e in made.items()]))


F_SQL = "f AS (SELECT * FROM files WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, hash DESC NULLS LAST) = 1)"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([F_SQL, *more])} {body}"


def tidy(c: Column | str) -> Column:
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))
