"""Helpers shared by the operators: durable tables, Arrow passes and input columns under fixed names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """The column of exactly this name, also if the name has dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, else the warehouse; both are shared by the cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/latticeqc-llm"


def written(df: DataFrame, *partitions: str, group_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors lose nothing.

    ``group_rows`` limits the rows of a row group, for rows of up to a MiB or more. Spark reads a row group of up to 4,096 rows
    as one batch, and Parquet ends a row group by its compressed bytes, a page after a hundred rows at the earliest.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = (df.write.partitionBy(*partitions) if partitions else df.write).option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if "/latticeqc-llm/" in name:
                jvm = table.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch. A batch is held by the JVM and by a worker at once, and each core has one.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut the session's Arrow batches by bytes; texts differ too much in length to count rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def inputs(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(*[column(name).alias(own) for own, name in columns.items()])


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``fn`` applied to each Arrow batch; a batch has about BATCH_BYTES at most."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return df.mapInArrow(run, schema)


#: A key is hot when it holds more than this part of all rows; there are fewer hot keys than HOT_SHARE.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has at most one row per key; null where it has none.

    A hot key would send all its rows to one task of a shuffled join. Fewer than HOT_SHARE keys can be hot, so their rows of
    ``table`` are broadcast whatever the size of the input, and only the other rows are shuffled. ``rows`` is read twice.
    """
    keys = list(keys)
    extra = [c for c in table.columns if c not in keys]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    limit = max(rows.count() // HOT_SHARE, HOT_SHARE)
    hot = written(table.join(counts.where(F.col("n_") > limit).select(*keys), keys, "left_semi").withColumn("hot_", F.lit(True)))
    marked = rows.join(F.broadcast(hot), keys, "left")
    near = marked.where("hot_").drop("hot_")
    far = marked.where("hot_ IS NULL").drop("hot_", *extra).join(table, keys, "left")
    return near.select(*rows.columns, *extra).unionByName(far.select(*rows.columns, *extra))


def scanned(rows: DataFrame, keys: Sequence[str], place: str, columns: Mapping[str, str], fold=F.sum, both=lambda a, b: a + b, reverse: bool = False, run: int = 1024) -> DataFrame:
    """Running folds along ``place`` inside each group of ``keys``; ``columns`` maps new names to the columns folded.

    ``both`` joins the folds of two runs. Windows cover runs of ``run`` places and, on top, one row per run, so that a group of
    any size is spread over tasks. ``rows`` is read twice.
    """
    keys = list(keys)
    order = F.desc if reverse else F.asc
    rows = rows.withColumn("run_", F.floor(F.col(place) / run))
    inside = Window.partitionBy(*keys, "run_").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(order("run_")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "run_").agg(*[fold(c).alias(f"{n}_before_") for n, c in columns.items()])
    before = totals.select(*keys, "run_", *[fold(f"{n}_before_").over(earlier).alias(f"{n}_before_") for n in columns])
    before = before.where(F.col(f"{next(iter(columns))}_before_").isNotNull())
    out = rows.withColumns({n: fold(c).over(inside) for n, c in columns.items()}).join(before, [*keys, "run_"], "left")
    whole = {n: F.when(F.col(f"{n}_before_").isNull(), F.col(n)).otherwise(both(F.col(n), F.col(f"{n}_before_"))) for n in columns}
    return out.withColumns(whole).drop("run_", *[f"{n}_before_" for n in columns])
