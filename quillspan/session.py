"""Session helpers shared by operators: the shared folder for cut lineage and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE); the master stays with the submitter."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local (tests) a temporary folder is used; on a cluster
    without the setting this raises, because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jdir = sc._jsc.sc().getCheckpointDir()
        d = jdir.get() if jdir.isDefined() else None
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quillspan-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder; ``clean_scratch`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


_scratch: list[str] = []


def clean_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this application has written to the shared folder, once nothing reads them any more: the
    results of operators read them until they are written or collected. Gives their number. Checkpoints go with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cut lineage as well as a known size, by which the planner
    broadcasts what turned out small and shuffles the rest."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def ship_file(spark: SparkSession, path: str) -> None:
    """Sends a file of the driver to the executors, once per application; ``shipped`` finds it there."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_quillspan_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)


def shipped(path: str) -> str:
    """Where a shipped file lies on this machine; the path itself where it was not shipped."""
    here = SparkFiles.get(os.path.basename(path))
    return here if os.path.exists(here) else path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    shared = shared_dir(spark).removeprefix("file://")
    # only the driver reads this file, it serves it to the executors
    folder = shared if os.path.isdir(shared) else tempfile.mkdtemp(prefix="quillspan-ship-")
    target = os.path.join(tempfile.mkdtemp(prefix="ship-", dir=folder), "quillspan.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    p = os.path.join(folder, name)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._quillspan_shipped = True
