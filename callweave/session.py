"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for these workloads on any cluster. Partition counts are left to AQE,
# which coalesces small partitions and splits skewed join partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Session setting, off unless given: tasks that text-heavy inputs are dealt out to.
INPUT_PARTITIONS = "spark.callweave.inputPartitions"


def local_session(cores: int | str = 8, app: str = "callweave", **extra: str) -> SparkSession:
    ship_by_value()
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out to as many tasks as the session asks for with INPUT_PARTITIONS; unset, the plan is left as it is.

    For machines with more cores than the input has splits, such as a small file of one row group.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df if wanted is None else df.repartition(int(wanted))


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. A machine-local folder is used only when the
    session itself is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix=f"spark-{purpose}-")
    return f"{base.rstrip('/')}/callweave-{purpose}-{os.urandom(6).hex()}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate that several branches read to the shared folder, and read it back.

    Branches do not recompute it, the plan stays short, and a lost executor costs nothing.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_by_value() -> None:
    """Send this package's functions to Python workers with the code that uses them.

    Workers then need no copy of the package on their path.
    """
    from pyspark import cloudpickle

    import callweave

    cloudpickle.register_pickle_by_value(callweave)

