"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (by default domain, language, source) in proportion to the weights. A
node never gets more than its subtree holds (tokens times ``max_epochs``); what it cannot use goes to its
siblings first, and only when all siblings are full does the parent hand it on to its own siblings. Each
leaf then takes whole seeded epochs and, from one more epoch in its own seeded order, the token prefix
that fits.

Everything is DataFrame code. Trees hold one row per node. The prefix of a leaf is found without sorting
the leaf in one task: token sums of 256 ranges of the seeded order give the range of the cut, that range is
cut in 256 again, and only what is left of it after the last step is sorted. Texts are not shuffled: the cut
is a filter on the seeded order.

Null level values are the branch ''. A document without tokens takes part with zero tokens. Rows with the
same id have the same place in the order and go in or out together. A node of weight 0 gets nothing. A
document whose tokens cross the budget ends the prefix and is left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeqc.llm.common import column, written

WORDS = r"[^\x20\x09-\x0D]+"
SPLIT = "\x1f"


@dataclass(frozen=True)
class Mix:
    """``budget_percent`` of all tokens are wanted; ``weights`` has whole numbers for a value of a level or for a path.

    Keys of ``weights`` are paths (tuples from the root) or single values; a path goes before a value, and
    what is not named weighs 1.
    """

    weights: Mapping[str | tuple[str, ...], int] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: str = "mix"
    steps: int = 3  # each narrows the cut 256 times


def word_tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def _weight(mix: Mix, path: Column, value: Column) -> Column:
    named = {SPLIT.join(k): v for k, v in mix.weights.items() if isinstance(k, tuple)}
    single = {k: v for k, v in mix.weights.items() if not isinstance(k, tuple)}
    parts = []
    for known, key in ((named, path), (single, value)):
        if known:
            pairs = [F.lit(x) for item in known.items() for x in item]
            parts.append(F.create_map(*pairs)[key])
    return F.coalesce(*parts, F.lit(1)).cast("bigint")


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Budgets of the children of each parent: ``cap`` where it is the smaller, the rest by weight."""
    within = Window.partitionBy(*parents)
    before = within.orderBy((F.col("cap") / F.col("weight")), *[F.col(c) for c in nodes.columns if c.startswith("level")]).rowsBetween(Window.unboundedPreceding, -1)
    cap_before = F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(within) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rated = nodes.where("weight > 0").withColumn("rate", (F.col("given") - cap_before) / weight_left)
    rated = rated.withColumn("full", F.col("cap") / F.col("weight") <= F.col("rate"))
    level = F.max(F.when(~F.col("full"), F.col("rate"))).over(within)
    return rated.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(level * F.col("weight"))).cast("bigint"))


def leaf_budgets(totals: DataFrame, depth: int, mix: Mix) -> DataFrame:
    """``level0..`` with ``tokens`` and ``budget`` from ``level0.., tokens``, level by level from the root."""
    names = [f"level{i}" for i in range(depth)]
    totals = totals.withColumn("cap", F.col("tokens") * mix.max_epochs)
    given = totals.agg(F.coalesce(F.floor(F.sum("tokens") * mix.budget_percent / F.lit(100)), F.lit(0)).cast("bigint").alias("given"))
    for i in range(depth):
        nodes = totals.groupBy(*names[: i + 1]).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(mix, F.concat_ws(SPLIT, *names[: i + 1]), F.col(names[i])))
        nodes = nodes.join(given, names[:i]) if i else nodes.crossJoin(F.broadcast(given))  # one row
        shared = written(_share(nodes, names[:i]).select(*names[: i + 1], "tokens", "budget"))
        given = shared.select(*names[: i + 1], F.col("budget").alias("given"))
    return shared


def mix_documents(docs: DataFrame, levels: Sequence[Column], mix: Mix, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are selected, with ``mix_epoch`` (from 0) and ``mix_tokens``; a row comes once per epoch.

    ``tokens`` and ``levels`` are expressions over ``docs``. Columns of ``docs`` called mix_epoch or mix_tokens are replaced.
    """
    names = [f"level{i}" for i in range(len(levels))]
    own = [F.coalesce(level.cast("string"), F.lit("")).alias(n) for n, level in zip(names, levels)]
    slim = written(docs.select(column(id_col).cast("string").alias("id"), tokens.cast("bigint").alias("tokens"), *own))
    totals = slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaves = leaf_budgets(totals, len(names), mix)
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    leaves = written(leaves.select(*names, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest")))

    def order(identity: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epochs").cast("string"), F.coalesce(identity, F.lit(""))))

    ranked = written(slim.join(leaves, names).withColumn("place", order(F.col("id"))).select(*names, "place", "tokens"))
    cut = leaves.select(*names, "rest", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    within = Window.partitionBy(*names).orderBy("range")
    for step in range(1, mix.steps + 1):
        inside = ranked.join(cut, names).where(F.substring("place", 1, 2 * step - 2) == F.col("prefix"))
        sums = inside.groupBy(*names, "rest", "before", F.substring("place", 1, 2 * step).alias("range")).agg(F.sum("tokens").alias("n"))
        passed = sums.withColumn("upto", F.col("before") + F.sum("n").over(within)).where("upto > rest")
        first = passed.groupBy(*names, "rest").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("sum")), "range").alias("at"))
        cut = written(first.select(*names, "rest", F.col("at.range").alias("prefix"), F.col("at.sum").alias("before")))
    inside = ranked.join(cut, names).where(F.substring("place", 1, 2 * mix.steps) == F.col("prefix"))
    peers = Window.partitionBy(*names).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(peers)).where("upto > rest").groupBy(*names).agg(F.min("place").alias("stop"))
    stops = written(leaves.join(last, names, "left"))

    keep = docs.drop("mix_epoch", "mix_tokens")
    kept_names = keep.columns
    inner = {c: f"in{i}" for i, c in enumerate(kept_names)}
    flat = docs.select(*[column(c).alias(inner[c]) for c in kept_names], column(id_col).cast("string").alias("id"), tokens.cast("bigint").alias("mix_tokens"), *own)
    placed = flat.join(stops, names).withColumn("place", order(F.col("id")))
    partial = (F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & (F.col("rest") > 0)
    times = F.col("epochs") + F.when(partial, 1).otherwise(0)
    chosen = placed.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    return chosen.select(*[F.col(inner[c]).alias(c) for c in kept_names], "mix_epoch", "mix_tokens")
