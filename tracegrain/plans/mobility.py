"""Composed plans over the derived inputs, shared by the catalogue's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import denoise, features, stays, transitions, zones
from ..sources import fixtures


#: The catalogue's queries use one threshold at every size.
REPEAT = 6


def binned(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Pings with zone (only those that have one) and time bin."""
    matched = zones.assign_zones(fixtures.pings(spark, sf_dir), fixtures.zones(spark), keep_unmatched=False)
    return zones.add_time_bin(matched, minutes)


def cleaned(spark: SparkSession, sf_dir: str, **options) -> dict[str, DataFrame]:
    """The stages of cleaning, by name."""
    return denoise.stages(fixtures.pings(spark, sf_dir), fixtures.towers(spark, sf_dir), **({"repeat": REPEAT} | options))


def zone_hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.assemble(features.per_ping(binned(spark, sf_dir)))


def dwell_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.dwell_transitions(binned(spark, sf_dir))


def stay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.stay_points(fixtures.pings(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded: results compare across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
