"""A frozen protocol against the one that a run would use, as nested documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeqc.session import materialize

# Parts of a protocol document, and the finding where a run's own document differs there.
PARTS = {
    "ids-differ": "$.source.selected_patch_ids_sha256",
    "configuration-differs": "$.frozen_detector.configuration",
    "offsets-differ": "$.protocol.normal_offsets_voxels",
    "widths-differ": "$.protocol.transition_widths_cells",
    "radius-differs": "$.protocol.annotation_neighborhood_radius_cells",
}
# Lists of ids that must not meet. The frozen document is looked at, whatever the run says.
DISJOINT = {
    "development-in-holdout": (("development_ids",), "selected_holdout_ids"),
    "component-leaks": (("development_ids", "development_related_excluded_ids"), "clean_holdout_pool_ids"),
}


def _nested(text: Column) -> Column:
    """Whether a value, given by its JSON text, has parts."""
    return F.substring(text, 1, 1).isin("{", "[") & ~text.isin("{}", "[]")


def _text(value: Column, text: Column) -> Column:
    """A value as text, from it and its JSON text; numbers of equal value have equal texts, as 4, 4.0 and 4e0."""
    number, kind = F.try_variant_get(value, "$", "double"), F.schema_of_variant(value)
    whole = (number == F.floor(number)) & (F.abs(number) < 2.0**53)
    plain = F.when(whole, number.cast("bigint").cast("string")).when(kind == "BIGINT", text).otherwise(number.cast("string"))
    return F.when(F.substring(text, 1, 1).isin(*"-0123456789"), plain).otherwise(text)


def path_values(docs: DataFrame, keys: Sequence[str], json_col: str = "raw_json", depth: int = 8) -> DataFrame:
    """``keys, path, value`` of every leaf of the JSON documents; empty objects and lists are leaves.

    Nesting is followed for ``depth`` levels, what lies deeper is one leaf with its JSON text (objects with sorted names), so
    nothing is left out. A text that is null or no JSON gives one row, with a null value at ``$``.
    """
    return _leaves(docs.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json_col).alias("_v")), keys, depth)


def _leaves(level: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """``keys, path, value`` of every leaf below the values ``_v`` at ``path``, which is followed for ``depth`` levels."""
    keys = list(keys)
    leaves = []
    for step in range(depth + 1):
        told = level.withColumn("_t", F.to_json("_v"))
        told = told.withColumn("_nested", F.coalesce(_nested(F.col("_t")), F.lit(False)) if step < depth else F.lit(False))
        # Written level by level, so that a plan holds one level and the loop ends with the deepest document.
        value = F.when(~F.col("_nested"), _text(F.col("_v"), F.col("_t"))).alias("value")
        parted = materialize(told.select(*keys, "path", F.when(F.col("_nested"), F.col("_v")).alias("_v"), "_nested", value))
        leaves.append(parted.where("NOT _nested").select(*keys, "path", "value"))
        inner = parted.where("_nested").withColumnRenamed("path", "_up")
        if inner.isEmpty():
            break
        parts = level.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_name", "_part")
        name = F.coalesce(F.concat(F.lit("."), "_name"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = inner.lateralJoin(parts).select(*keys, F.concat("_up", name).alias("path"), F.col("_part").alias("_v"))
    return reduce(DataFrame.unionByName, leaves)


def protocol_differences(frozen: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, path, frozen, seen`` of two tables of leaves where they differ; a side without the path is null."""
    keys = [*keys, "path"]
    a = frozen.select(*keys, F.col("value").alias("frozen"), F.lit(True).alias("_a"))
    b = seen.select(*keys, F.col("value").alias("seen"), F.lit(True).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    same = F.col("_a") & F.col("_b") & F.col("frozen").eqNullSafe(F.col("seen"))
    return joined.where(~F.coalesce(same, F.lit(False))).select(*keys, "frozen", "seen")


def _ids(name: str) -> Column:
    """The texts of a list of ids of the document ``_v``; parts of it that are lists or objects are no ids."""
    listed = F.transform(F.try_variant_get("_v", f"$.split.{name}", "array<variant>"), lambda v: F.struct(v.alias("v"), F.to_json(v).alias("t")))
    kept = F.filter(listed, lambda v: ~F.coalesce(_nested(v["t"]), F.lit(False)))
    return F.coalesce(F.transform(kept, lambda v: _text(v["v"], v["t"])), F.array().cast("array<string>"))


def _met(left: Sequence[str], right: str) -> Column:
    """How many ids of the document ``_v`` are in one of the lists ``left`` and in ``right``; ``_lists`` has the lists as strings.

    Equal ids are equal strings but for numbers, so only documents with numbers, equal strings or without a list are looked at value by value.
    """
    some, other = F.concat(*[F.col(f"_lists.{name}") for name in left]), F.col(f"_lists.{right}")
    apart = (F.size(F.array_intersect(some, other)) == 0) & ~F.concat_ws("\n", some, other).rlike(r"(?m)^-?[0-9.]+(E[-+]?[0-9]+)?$")
    return F.when(apart, 0).otherwise(F.size(F.array_intersect(F.concat(*map(_ids, left)), _ids(right))))


def _by_key(docs: DataFrame, keys: list[str], side: str, more: Sequence[Column] = ()) -> DataFrame:
    """Per key the number of documents, and the least and largest hash of each part's canonical text."""
    hashes = [F.xxhash64(F.coalesce(F.to_json(F.try_variant_get("_v", part, "variant")), F.lit(""))).alias(f"_h{i}") for i, part in enumerate(PARTS.values())]
    hashed = docs.select(*keys, *hashes, *more)
    ends = [f(f"_h{i}").alias(f"{side}{name}{i}") for i in range(len(PARTS)) for f, name in ((F.min, "low"), (F.max, "high"))]
    sums = [F.sum(c).alias(c) for c in hashed.columns if c.startswith("_sum")]
    return hashed.groupBy(*keys).agg(F.count("*").alias(f"{side}n"), *ends, *sums)


def protocol_findings(frozen: DataFrame, seen: DataFrame, keys: Sequence[str], schema: str, json_col: str = "raw_json") -> DataFrame:
    """``keys, code, n``: what keeps a run from using the frozen protocol of its key.

    ``n`` counts differing leaves, or ids that are in two lists that must not meet (each id once). A key in one table only
    differs in every part that the document there has; a frozen document of another ``schema`` is unsupported. Keys are
    unique in either table; null keys never meet.

    A part whose canonical text (objects with sorted names) is the same in all documents of a key on both sides has the same leaves
    in them, so only the other parts are taken apart. Texts are compared by 64-bit hashes.
    """
    keys = list(keys)
    parsed = F.try_parse_json(json_col).alias("_v")
    ours, theirs = (t.select(*keys, parsed) for t in (frozen, seen))
    stated = F.to_json(F.try_variant_get("_v", "$.schema_version", "variant"))
    stated, wanted = F.when(~_nested(stated), stated), F.lit(f'"{schema}"')
    lists = sorted({name for left, right in DISJOINT.values() for name in (*left, right)})
    met = [_met(left, right).alias(f"_sum{i}") for i, (left, right) in enumerate(DISJOINT.values())]
    # The largest version stated for a key has to be the wanted one.
    version = [F.coalesce(c.cast("int"), F.lit(0)).alias(name) for c, name in ((stated == wanted, "_sum_same"), (stated > wanted, "_sum_above"))]
    listed = ours.withColumn("_lists", F.try_variant_get("_v", "$.split", f"struct<{', '.join(f'{name}: array<string>' for name in lists)}>"))
    both = _by_key(listed, keys, "_a", [*met, *version]).join(_by_key(theirs, keys, "_b"), keys, "full_outer")
    equal = [F.expr(f"_alow{i} = _ahigh{i} AND _blow{i} = _bhigh{i} AND _alow{i} = _blow{i}") for i in range(len(PARTS))]
    unlike = F.array(*[F.when(~F.coalesce(e, F.lit(False)), F.lit(part)) for e, part in zip(equal, PARTS.values())])
    empty = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    both = both.select(
        *keys, F.filter(unlike, lambda p: p.isNotNull()).alias("_unlike"), (F.col("_an") > 0).alias("_frozen"), (F.col("_an") > 1).alias("_many"),
        ((F.col("_sum_same") == 0) | (F.col("_sum_above") > 0)).alias("_unsupported"), *[f"_sum{i}" for i in range(len(DISJOINT))],
    )
    met_any = reduce(Column.__or__, [F.col(f"_sum{i}") > 0 for i in range(len(DISJOINT))])
    odd = materialize(both.where((F.size("_unlike") > 0) | F.coalesce(F.col("_unsupported") | F.col("_many") | met_any, F.lit(False))))

    def with_null_keys(docs: DataFrame, flagged: DataFrame) -> DataFrame:
        everywhere = F.array(*map(F.lit, PARTS.values())).alias("_unlike")
        docs = docs.select(*keys, json_col)
        chosen = docs.where(~empty).join(flagged.select(*keys, "_unlike"), keys).unionByName(docs.where(empty).withColumn("_unlike", everywhere))
        return chosen.select(*keys, "_unlike", parsed)

    def parts(docs: DataFrame) -> DataFrame:
        chosen = F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get("_v", p, "variant").alias("_v")) for p in PARTS.values()])
        chosen = F.filter(chosen, lambda p: F.array_contains("_unlike", p["path"]) & p["_v"].isNotNull())
        found = with_null_keys(docs, odd.where("size(_unlike) > 0")).select(*keys, F.inline(chosen))
        return _leaves(found, keys, depth=6)

    code = F.lit(None).cast("string")
    for name, part in PARTS.items():
        inside = (F.col("path") == part) | F.startswith("path", F.lit(part + ".")) | F.startswith("path", F.lit(part + "["))
        code = F.when(inside, name).otherwise(code)
    out = protocol_differences(parts(frozen), parts(seen), keys).select(*keys, code.alias("code")).where("code IS NOT NULL")
    out = out.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    out = out.unionByName(odd.where("_unsupported").select(*keys, F.lit("unsupported-schema").alias("code"), F.lit(1).cast("bigint").alias("n")))
    # Ids of keys with one document were met in it; documents that share a key, or have none, put theirs together.
    shared = with_null_keys(frozen, odd.where("_many"))
    for i, (name, (left, right)) in enumerate(DISJOINT.items()):
        single = odd.where(F.col("_frozen") & ~F.col("_many") & ~empty & (F.col(f"_sum{i}") > 0))
        out = out.unionByName(single.select(*keys, F.lit(name).alias("code"), F.col(f"_sum{i}").cast("bigint").alias("n")))
        ids = [shared.select(*keys, F.explode(F.concat(*map(_ids, names))).alias("value"), F.lit(at).alias("_at")) for at, names in ((0, left), (1, [right]))]
        both_sides = ids[0].unionByName(ids[1]).groupBy(*keys, "value").agg(F.min("_at").alias("_l"), F.max("_at").alias("_r")).where("_l < _r")
        out = out.unionByName(both_sides.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(name).alias("code"), "n"))
    return out
