"""Persisted JSON state: tolerant reading, defaults, export and reset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricewright.operators.guards import price_form_errors, split_valid

PRICE_SCHEMA = (
    "id string, game_id string, book string, market string, selection string, line double, american double, "
    "age_minutes double, confirmed boolean, entered_at timestamp, seq long"
)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price rows below a folder of JSON lines; corrupt lines are left out, a missing folder is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], PRICE_SCHEMA)
    rows = spark.read.schema(PRICE_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def submit_prices(rows: DataFrame, path: str) -> DataFrame:
    """Appends valid rows to the price folder and returns the rejected ones with their errors."""
    good, bad = split_valid(price_form_errors(rows))
    good.write.mode("append").json(path)
    return bad


def parsed_state(json: Column, schema: StructType | str, defaults: Mapping[str, Column | Mapping]) -> Column:
    """A struct from a JSON column; absent fields, and all of a corrupt text, take their defaults.

    A default that is itself a mapping is merged field by field, at any depth.
    """
    return _with_defaults(F.from_json(json, schema), defaults)


def _with_defaults(state: Column, defaults: Mapping[str, Column | Mapping]) -> Column:
    value = lambda name, d: _with_defaults(state[name], d) if isinstance(d, Mapping) else F.coalesce(state[name], d)
    return F.struct(*(value(name, d).alias(name) for name, d in defaults.items()))


def export_state(tables: Mapping[str, DataFrame], path: str) -> None:
    """Every table as JSON lines below ``path``; written by the executors."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def reset_state(tables: Mapping[str, DataFrame], path: str) -> None:
    export_state({name: df.limit(0) for name, df in tables.items()}, path)
