"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Settings that the library's results rely on; see ``operators.unions``.
REQUIRED = {"spark.sql.unionOutputPartitioning": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Give a session of your own the settings that the library relies on."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "sparkodds", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and bench; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the checkpoint folder of the session or the
    one the cluster names in ``spark.checkpoint.dir``. Only a local master
    without either gets a temporary folder; elsewhere that is an error, because
    a machine-local folder would not be readable by the other executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="sparkodds-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path for a table of this process, which ``drop_intermediate`` deletes."""
    _WRITTEN.append(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a written table: what reads the result several times
    computes it once, and a lost executor loses nothing. As parquet the table is
    pruned by column, and its size on disk tells Spark whether it may be
    broadcast."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the tables that this process has written by ``materialize``, and say
    how many. Call it at the end of a job, when its results are stored: frames
    that read those tables can't be used afterwards."""
    done = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done
