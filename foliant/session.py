"""Session settings, table loading and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
#: The tables that written() made: the session, and a weak reference of the JVM to the relation that plans read.
_written: dict[str, tuple[SparkSession, object]] = {}
#: Tables made since unused ones were last looked for.
_since = 0
SWEEP_EVERY = 64
#: The temporary folder of each local application that names none.
_own: dict[str, str] = {}


def get_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the engine's settings; on a cluster, use the one that is given."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions)
    b = b.config("spark.driver.memory", memory)
    for k, v in _SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local master
    gets a temporary folder of its own; any other master is refused, as executors could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="foliant-")
            _written[_own[app]] = (spark, None)
        at = _own[app]
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, outlives lost executors and is
    computed once however many plans read it. The table is deleted some time after the last plan that reads it is
    gone, or by release(), or when the session's Python ends."""
    global _since
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    relation = out._jdf.queryExecution().analyzed().relation()  # shared by all plans made of it
    _written[at] = (spark, spark._jvm.java.lang.ref.WeakReference(relation))
    del relation
    _since += 1
    if _since >= SWEEP_EVERY:
        _since = 0
        spark._jvm.System.gc()
        sweep()
    return out


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast, if it is found to have at most `most` rows; else as it is, for the planner to join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges that adaptive execution must not merge as their rows
    are few bytes but much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete(at: str) -> None:
    spark, _ = _written.pop(at)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended
        pass


def sweep() -> None:
    """Delete the tables that no plan reads any more."""
    for at, (_, reader) in list(_written.items()):
        try:
            gone = reader is not None and reader.get() is None
        except Exception:  # the session may have ended
            gone = True
        if gone:
            _delete(at)


def release() -> None:
    """Delete the tables that written() made; plans that read them can't run any more."""
    for at in list(_written):
        _delete(at)


atexit.register(release)
