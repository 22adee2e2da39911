"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Most documents that one Arrow batch may hold; with the longest texts a batch stays in memory.
BATCH_ROWS = 1000


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/factweave-shared"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and gives Catalyst the
    table's true size, so that it broadcasts only what is small. The folder
    goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch holds for a Python worker; a lower setting of the session stays. Ships the package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame, id_col: str, nulls_first: bool = True) -> tuple[DataFrame, str]:
    """docs with a column that no two rows share and that is ordered as the ids, and its name.

    It is the id itself where ids are unique. Else it is the id with the row's
    number, which is written once with the table, so that all that is decided
    by it means one row. Only ids are read to find out. A null id comes before
    all others, or after them. Columns of docs keep their names and values.
    """
    row = fresh("_row", docs.columns)
    own = quoted(id_col)
    repeated = docs.select(own.alias("id")).groupBy("id").count().filter("count > 1")
    if repeated.isEmpty():
        return docs.withColumn(row, own), row
    key = F.struct((own.isNotNull() if nulls_first else own.isNull()).alias("rank"), own.alias("id"), F.monotonically_increasing_id().alias("n"))
    return materialize(docs.withColumn(row, key), "rows"), row


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among those of dropped, its first column; a null id matches null."""
    gone = dropped.select(quoted(dropped.columns[0]).alias("gone"))
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["gone"]), "left_anti")
