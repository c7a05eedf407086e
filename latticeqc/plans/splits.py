"""Leakage-free splits over the components of an overlap graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.operators.components import graph_components
from latticeqc.operators.digest import set_digest
from latticeqc.operators.ordering import with_global_position
from latticeqc.session import materialize


def _names(labels: DataFrame) -> DataFrame:
    """``label, size, members``: number of nodes and the digest of them, by one rule for every size."""
    return labels.groupBy("label").agg(F.count("*").alias("size"), set_digest(F.col("node")).alias("members"))


def component_ids(labels: DataFrame) -> DataFrame:
    """``node, label, size, component_id`` with the id a digest of the component's members."""
    named = materialize(
        _names(labels).select("label", "size", F.concat(F.lit("sha256:"), F.col("members")).alias("component_id"))
    )
    return labels.join(named, "label")


def holdout_select(labels: DataFrame, target: int, salt: str) -> DataFrame:
    """Components in salted hash order, whole ones, until at least ``target`` nodes are taken."""
    if target < 1:
        raise ValueError("the holdout target has to be 1 or more")
    ranked = _names(labels).withColumn("rank_hash", F.sha2(F.concat(F.lit(salt + "\0"), F.col("members")), 256))
    placed = with_global_position(ranked, ["rank_hash", "members"], weight="size")
    return placed.where(F.col("running") - F.col("size") < target).select(
        "label", "size", "rank_hash", F.col("pos").alias("place"), F.col("running").cast("bigint").alias("running")
    )


def development_exclusion(labels: DataFrame, development: DataFrame) -> DataFrame:
    """``node, label, role``: development, excluded (same component as a development node) or clean."""
    dev = development.select("node").distinct().withColumn("dev", F.lit(True))
    touched = labels.join(dev, "node", "left_semi").select("label").distinct().withColumn("touched", F.lit(True))
    role = F.when(F.col("dev"), "development").when(F.col("touched"), "excluded").otherwise("clean")
    return labels.join(dev, "node", "left").join(touched, "label", "left").select("node", "label", role.alias("role"))


def isolated_split(nodes: DataFrame, edges: DataFrame, development: DataFrame, target: int, salt: str) -> DataFrame:
    """``node, component_id, role`` with the holdout drawn from components without development nodes."""
    if development.join(nodes, "node", "left_anti").limit(1).count():
        raise ValueError("development nodes are missing from the node table")
    labels = materialize(graph_components(nodes, edges))
    roles = materialize(development_exclusion(labels, development))
    held = holdout_select(roles.where("role = 'clean'").select("node", "label"), target, salt)
    held = held.select("label", F.lit(True).alias("held"))
    named = component_ids(labels).select("node", "component_id")
    role = F.when(F.col("held"), "holdout").otherwise(F.col("role"))
    return roles.join(held, "label", "left").join(named, "node").select("node", "component_id", role.alias("role"))


def disjointness(parts: DataFrame) -> DataFrame:
    """One row on ``component_id, role``: components, those with nodes on both sides, nodes, development and holdout."""
    sides = parts.groupBy("component_id").agg(
        F.bool_or(F.col("role").isin("development", "excluded")).alias("d"), F.bool_or(F.col("role").isin("holdout", "clean")).alias("h"),
        F.count("*").alias("n"), F.count_if(F.col("role") == "development").alias("dn"), F.count_if(F.col("role") == "holdout").alias("hn"),
    )
    return sides.agg(
        F.count("*").alias("components"), F.count_if(F.col("d") & F.col("h")).cast("int").alias("mixed_components"), F.sum("n").alias("nodes"),
        F.sum("dn").alias("development"), F.sum("hn").alias("holdout"),
    )
