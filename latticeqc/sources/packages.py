"""Package discovery and file-level checks on a listing ``dir, filename, ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of a surface package.
REQUIRED = ("x.tif", "y.tif", "z.tif", "meta.json")
MASK = "mask.tif"


def list_files(spark: SparkSession, root: str, names: tuple[str, ...] = (*REQUIRED, MASK), content: bool = False) -> DataFrame:
    """``dir, filename, bytes, mtime`` (and ``content``) of package files below ``root``.

    The content column is only read from disk when asked for.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(names) + "}")
        .load(root)
    )
    out = files.select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("filename"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("mtime"),
        "content",
    )
    return out if content else out.drop("content")


def discover_packages(files: DataFrame) -> DataFrame:
    """Every directory with at least one required file, incomplete ones included."""
    return files.where(F.col("filename").isin(*REQUIRED)).select("dir").distinct()


def file_presence(requested: DataFrame, files: DataFrame) -> DataFrame:
    """``dir, exists`` and one flag per package file for every requested directory."""
    flags = [F.bool_or(F.col("filename") == n).alias(_flag(n)) for n in (*REQUIRED, MASK)]
    seen = files.groupBy("dir").agg(F.lit(True).alias("exists"), *flags)
    no = F.lit(False)
    joined = requested.join(seen, "dir", "left")
    return joined.select("dir", *[F.coalesce(c, no).alias(c) for c in ["exists", *map(_flag, (*REQUIRED, MASK))]])


def _flag(name: str) -> str:
    return "has_" + name.split(".")[0]


def complete_packages(files: DataFrame, prefix: str) -> DataFrame:
    """Directories with the prefix that hold every required file."""
    named = files.where(F.startswith("dir", F.lit(prefix)) & F.col("filename").isin(*REQUIRED))
    return named.groupBy("dir").agg(F.count_distinct("filename").alias("n")).where(F.col("n") == len(REQUIRED)).select("dir")


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("dir", "filename", F.sha2("content", 256).alias("sha256"), "bytes")


def verify_manifest(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Status per file: size and hash against the manifest, missing and unlisted files, plain-http sources."""
    want = expected.select(*keys, "url", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"), F.lit(1).alias("_e"))
    have = observed.select(*keys, "bytes", "sha256", F.lit(1).alias("_o"))
    status = (
        F.when(F.col("_e").isNull(), "unlisted")
        .when(~F.startswith("url", F.lit("https://")), "insecure-url")
        .when(F.col("_o").isNull(), "missing")
        .when(F.col("want_bytes").isNotNull() & (F.col("want_bytes") != F.col("bytes")), "size-mismatch")
        .when(F.col("want_sha").isNotNull() & (F.col("want_sha") != F.col("sha256")), "hash-mismatch")
        .otherwise("verified")
    )
    return want.join(have, keys, "full_outer").select(*keys, status.alias("status"))


def overlap_edges(documents: DataFrame, nodes: DataFrame, prefix: str = "between_patches__") -> DataFrame:
    """Undirected edges named ``<prefix>A__B`` between different known nodes, endpoints in order."""
    parsed = F.from_json("raw_json", "collections MAP<STRING, STRUCT<name: STRING>>")
    named = documents.select(F.explode(F.map_values(parsed["collections"])).alias("c")).select(F.col("c.name").alias("name"))
    ends = F.split(F.expr(f"substring(name, {len(prefix) + 1})"), "__")
    pairs = (
        named.where(F.startswith("name", F.lit(prefix))).select(ends.alias("e")).where(F.size("e") == 2)
        .select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).where("a <> b")
    )
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.select("a", "b")


def pair_images_labels(files: DataFrame) -> DataFrame:
    """``image, label, paired`` for every ``*_0000.tif``; the label has the same stem."""
    images = files.where(F.endswith("name", F.lit("_0000.tif"))).select(
        F.col("name").alias("image"), F.regexp_replace("name", "_0000\\.tif$", ".tif").alias("label")
    )
    labels = files.where(F.endswith("name", F.lit(".tif")) & ~F.endswith("name", F.lit("_0000.tif"))).select(
        F.col("name").alias("label"), F.lit(True).alias("paired")
    )
    return images.join(labels, "label", "left").select("image", "label", F.coalesce("paired", F.lit(False)).alias("paired"))


def select_cases(cases: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted cases, and the wanted ids that do not exist (an error for the caller)."""
    ids = wanted.select(key).distinct()
    return cases.join(ids, key, "left_semi"), ids.join(cases, key, "left_anti")
