"""SQL over DataFrames by name."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run ``text``, in which ``$name`` stands for the frame of that name."""
    names = {}
    for name, frame in frames.items():
        names[name] = f"v_{name}_{uuid.uuid4().hex[:12]}"
        frame.createOrReplaceTempView(names[name])
    try:
        return spark.sql(re.sub(r"\$([a-z_]\w*)", lambda m: names[m[1]], text))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
