"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once for each Spark context, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_factweave_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="factweave-")) / "factweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, f"factweave/{path.relative_to(home)}")
    context.addPyFile(str(target))
    context._factweave_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in the one that spark.checkpoint.dir names. Only a local session may do without that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/factweave-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
