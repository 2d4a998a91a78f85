"""SparkSession settings the toolkit is designed for.

On a cluster these belong in the job's configuration; ``build_session`` is
for local runs (tests, bench). AQE must stay on: it turns joins against
small aggregated sides into broadcast joins once their real size is known,
coalesces small shuffle partitions and splits skewed ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = "local[8]",
    shuffle_partitions: int | None = 8,
    app: str = "churnscope",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the recommended settings. ``master=None`` and
    ``shuffle_partitions=None`` leave both to the launcher (spark-submit on a
    cluster)."""
    b = SparkSession.builder.appName(app)
    if master is not None:
        b = b.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
