"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC throughout; the last of repeated JSON keys counts; payload keys may be replaced; rows that come sorted by their group aren't hashed;
#: shuffle files go when the action that made them ends, not when the driver happens to collect its garbage.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
