"""Session settings that the operators rely on."""

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.variable.substitute": "false", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true"}


def configured(spark: SparkSession) -> SparkSession:
    """Placeholders such as ${name} are data here: SQL text must never substitute them; later map entries win."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
