"""SparkSession factory and the few runtime settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settable at runtime, so they also apply to a session somebody else created.
RUNTIME_CONF = {
    # Event times are zone-less in the inputs; every epoch computation assumes UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the partition of a hot join key (one content hash, one document) at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# transformWithState keeps its state in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers are pickled by name, so the package has to be
    importable there, wherever the driver was started from.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="parchmill-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and ship the package to it."""
    ship_package(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def configure_streaming(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return configure(spark)


def create_session(app_name: str = "parchmill", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. On a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = {"spark.ui.enabled": "false"} if master and master.startswith("local") else {}
    for key, value in {**RUNTIME_CONF, **local, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def spread(scan: DataFrame) -> DataFrame:
    """Give costly per-row work on a scan enough tasks.

    A file of one row group is read by one task, however many splits it is cut into.
    An input of less than two splits per core is therefore dealt out evenly; a larger
    one is left alone: no shuffle. Only for plain scans, as counting splits plans the query.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 2 * cores else scan.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A machine-local folder is only chosen for a local master, where driver and
    executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="parchmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    For results that several branches of a plan read: each branch would otherwise
    compute them anew, and a lost executor would start them over. A parquet table
    is computed once (``checkpoint`` computes twice) and is read column by column.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
