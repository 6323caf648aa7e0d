"""Borders between the stages of a flow: in the plan, and as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: what follows has a plan of its own, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The same rows; the columns are computed once, here. Without it the optimizer would copy the expressions of a stage into every use that later stages make of them, lambdas included, where they run once for each element."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
