"""Session settings that the queries of this package want."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Generated methods of more bytecode are never compiled by the JVM (its own limit is 8000), so they run many times slower
#: than the split functions that Spark falls back to.  Projections of dozens of expressions reach it easily.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")
SPARKS_DEFAULT = "65535"


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with settings it has not been given yet; what a user has set stays."""
    key, value = HUGE_METHOD
    if spark.conf.get(key, SPARKS_DEFAULT) == SPARKS_DEFAULT:
        spark.conf.set(key, value)
    return spark
