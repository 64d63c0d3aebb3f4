"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def build_session(app: str = "periodica", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in a local session
    without settings, one folder is made for the application and removed when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="periodica-")
            atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
        root = _LOCAL[application]
    return f"{root.rstrip('/')}/periodica-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Path, bytes and last change of a file, or of the files in a folder: other content has another state."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(place)
    return path, sum(f.getLen() for f in held), max((f.getModificationTime() for f in held), default=0)


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
