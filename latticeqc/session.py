"""Session settings and durable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "latticeqc", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Folder for the intermediate tables of this run, below a folder that the cluster shares.

    That is ``spark.checkpoint.dir``, or the warehouse where none is set; never a folder of one machine's own choosing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/latticeqc-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back.

    This cuts lineage in a way that survives lost executors, and it gives Catalyst the true size of
    the table: a join against it is broadcast only when the files are below the broadcast limit.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that is sorted and merged, whatever the size of its files.

    A table is broadcast through the driver by the bytes of its files, and places and keys that repeat take next to nothing
    there: 2,963,520 cells were 0.3 MB, and 437,310 component labels of 1 MB were 61 MB in memory. This is for joins of
    tables with a row for each cell, component or case; a join of wide rows with a few numbers for each case is left to Spark.
    """
    return table.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` over the session's number of shuffle partitions.

    AQE joins partitions that are small in bytes, which leaves few tasks for rows that are small but cost much time each.
    It leaves a stated number as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


#: Bytes of an Arrow batch. Rows of packed tiles or lists are large, so a batch of the usual 10,000 rows would grow with the input.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut the session's Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for table in tables:
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/latticeqc-" in name:
                _delete(table.sparkSession, name)


def clear_work(spark: SparkSession) -> None:
    """Delete all intermediate tables of this run; results that still read them have to be written before."""
    _delete(spark, work_folder(spark))


def prefer_small_methods(spark: SparkSession) -> None:
    """The JVM never compiles methods above 8000 bytes of bytecode to machine code.

    A fused stage with hundreds of expressions passes that size and then runs several times slower
    than the same projections split into small methods, which is what this limit makes Spark choose.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
