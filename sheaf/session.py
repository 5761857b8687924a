"""Session construction and lineage cutting."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library wants; callers may override any of them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "sheaf",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` wins. Only when the session has none is
    ``fallback`` used, or, where driver and executors are one process, a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if not target and sc.master.partition("[")[0] == "local":
        import tempfile
        target = tempfile.mkdtemp(prefix="sheaf-checkpoints-")
    if not target:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local checkpoint."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark, fallback_dir)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that is no longer needed, in whatever store Spark wrote it."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set = set()


def _package_zip() -> bytes:
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``sheaf`` importable in Python workers (like ``--py-files``), once per context.

    Pandas functions that run in tasks refer to this package. Its zip is written to
    the cluster's shared checkpoint folder (Hadoop FileSystem API) and added with
    ``SparkContext.addPyFile``; only a session without that folder (local tests)
    falls back to a driver-local file.
    """
    import uuid

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    data = _package_zip()
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        jvm = sc._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/sheaf-pkg-{uuid.uuid4().hex}.zip")
        fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        sc.addPyFile(target.toString())
    else:
        import tempfile
        fd, path = tempfile.mkstemp(prefix="sheaf-", suffix=".zip")
        with os.fdopen(fd, "wb") as fh:
            fh.write(data)
        sc.addPyFile(path)
    _SHIPPED.add(key)
