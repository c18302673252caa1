"""Light logger calibration factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import dimension
from .scans import scan_typed_csv

SCHEMA = "id INT, calibration_coefficient DOUBLE"

# Coefficient of each light logger of the 2018 calibration.
COEFFICIENTS = {
    41: 0.07693886736626032,
    42: 0.07592484116177821,
    43: 0.07699535055087224,
    44: 0.2173217841891445,
    45: 0.19419013437636518,
    46: 0.07674081996810637,
    91: 0.09236339709340602,
    92: 0.1079841270990315,
    93: 0.09815462930577104,
    94: 0.0978636449856658,
    73: 0.15359027892572258,
    74: 0.11866053354399998,
    76: 0.10454539455380216,
    90: 0.11959617258400462,
}


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Factor per logger id; the file has a header and one line per logger."""
    return scan_typed_csv(spark, path, SCHEMA)


def calibration(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(COEFFICIENTS.items()), ["id", "calibration_coefficient"])
