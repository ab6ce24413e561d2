"""User-supplied predictors over table rows: plain, cached and cascaded."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from visorlake.operators.sampling import cap_per_group

# A factory returns a function from a frame of input rows to a frame of output rows.
Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def predict(df: DataFrame, factory: Factory, schema: T.StructType | str, batch: int = 256) -> DataFrame:
    """Run a predictor over all rows. The model is made once per task and sees at most `batch` rows at a time."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            for lo in range(0, len(part), batch):
                yield model(part.iloc[lo:lo + batch])

    return df.mapInPandas(run, schema)


def predict_cached(df: DataFrame, cache_path: str, factory: Factory, schema: T.StructType, key="sample_id", batch: int = 256) -> DataFrame:
    """Predict only the rows whose key is not in the cache folder, append them, and return all of them.

    Thresholds apply to the stored scores afterwards, so changing one runs no model. Outputs carry the key;
    rows for which the model finds nothing must be returned with nulls, or they are predicted again.
    """
    spark = df.sparkSession
    try:
        known = spark.read.schema(schema).parquet(cache_path)
        todo = df.join(known.select(key).distinct(), key, "left_anti")
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        todo = df
    predict(todo, factory, schema, batch).write.mode("append").parquet(cache_path)
    return spark.read.schema(schema).parquet(cache_path).join(df.select(key), key, "left_semi")


def cascade(df: DataFrame, cheap: Factory, cheap_schema: T.StructType, keep: Column, costly: Factory, costly_schema: T.StructType,
            cap_keys: list[str] | None = None, cap: int = 0, order: str = "sample_id", batch: int = 256, key="sample_id") -> tuple[DataFrame, DataFrame]:
    """The costly predictor sees only rows that the cheap one kept, optionally capped per group.

    Returns the cheap outputs of the kept rows and the costly outputs.
    """
    first = predict(df, cheap, cheap_schema, batch).where(keep)
    kept = df.join(first.select(key).distinct(), key, "left_semi")
    if cap:
        kept = cap_per_group(kept, cap_keys or [], [order], cap)
    return first.join(kept.select(key), key, "left_semi"), predict(kept, costly, costly_schema, max(1, batch // 2))
