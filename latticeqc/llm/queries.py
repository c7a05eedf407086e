"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeqc.llm.common import written
from latticeqc.llm import alignment, compression, cover_tree, html_labeller, license_scan, minhash_forest, mixing, ngram_scoring, prefix_trie, sentencepiece_table, separator_scan, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@query("op1_ngram_trie_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return ngram_scoring.score_documents(table(spark, sf_dir, "documents"), learned)


@query("op2_minhash_forest_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op3_html_block_labeller")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_labeller.extract(pages, html_labeller.train(pages))


#: Domains group sources by number; target weights of domains and languages, sources of one language weigh the same.
TARGETS = mixing.Mix(weights={"d0": 1, "d1": 3, "d2": 3, "d3": 2, "en": 5, "de": 2, "fr": 2, "es": 1})
#: In the pipeline each document comes once at most, and nearly all tokens are wanted: only what the weights push out goes.
PIPELINE_TARGETS = mixing.Mix(weights=TARGETS.weights, budget_percent=90, max_epochs=1)


def domain() -> Column:
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int")
    return F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(4)).cast("string"))


def levels() -> tuple[Column, ...]:
    return domain(), F.col("lang"), F.col("source")


MIXING_SQL = """
WITH docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
         'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 0) % 4) AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2
  FROM documents),
named(value, weight) AS (VALUES ('d0', 1), ('d1', 3), ('d2', 3), ('d3', 2), ('en', 5), ('de', 2), ('fr', 2), ('es', 1)),
n0 AS (SELECT l0, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap, any_value(coalesce(weight, 1)) AS weight,
              (SELECT floor(sum(tokens) * 60 / 100.0)::BIGINT FROM docs) AS given
       FROM docs LEFT JOIN named ON value = l0 GROUP BY l0),
r0 AS (SELECT *, (given - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS rate FROM n0
       WINDOW w AS (ORDER BY cap / weight, l0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b0 AS (SELECT l0, (CASE WHEN cap / weight <= rate THEN cap ELSE floor(max(CASE WHEN cap / weight > rate THEN rate END) OVER () * weight) END)::BIGINT AS budget FROM r0),
n1 AS (SELECT l0, l1, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap, any_value(coalesce(weight, 1)) AS weight, any_value(budget) AS given
       FROM docs JOIN b0 USING (l0) LEFT JOIN named ON value = l1 GROUP BY l0, l1),
r1 AS (SELECT *, (given - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER (PARTITION BY l0) - coalesce(sum(weight) OVER w, 0)) AS rate FROM n1
       WINDOW w AS (PARTITION BY l0 ORDER BY cap / weight, l1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b1 AS (SELECT l0, l1, (CASE WHEN cap / weight <= rate THEN cap ELSE floor(max(CASE WHEN cap / weight > rate THEN rate END) OVER (PARTITION BY l0) * weight) END)::BIGINT AS budget FROM r1),
n2 AS (SELECT l0, l1, l2, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap, 1 AS weight, any_value(budget) AS given
       FROM docs JOIN b1 USING (l0, l1) GROUP BY l0, l1, l2),
r2 AS (SELECT *, (given - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER (PARTITION BY l0, l1) - coalesce(sum(weight) OVER w, 0)) AS rate FROM n2
       WINDOW w AS (PARTITION BY l0, l1 ORDER BY cap / weight, l2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b2 AS (SELECT l0, l1, l2, tokens AS held, (CASE WHEN cap / weight <= rate THEN cap ELSE floor(max(CASE WHEN cap / weight > rate THEN rate END) OVER (PARTITION BY l0, l1) * weight) END)::BIGINT AS budget FROM r2),
leaves AS (SELECT l0, l1, l2, CASE WHEN held > 0 THEN budget // held ELSE 0 END AS epochs, budget - held * CASE WHEN held > 0 THEN budget // held ELSE 0 END AS rest FROM b2),
placed AS (SELECT docs.*, epochs, rest, md5('mix:' || epochs || ':' || doc_id) AS place FROM docs JOIN leaves USING (l0, l1, l2)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
timed AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, l0 AS domain, l1 AS lang, l2 AS source, tokens AS n_tokens, unnest(range(times))::INT AS epoch FROM timed WHERE times > 0
"""


@query("op4_source_mixing", MIXING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_documents(docs, levels(), TARGETS, mixing.word_tokens(F.col("text")))
    return mixed.select(
        "doc_id", domain().alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch")
    )


@query("op5_url_association_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_rules.mine_rules(url_rules.label_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge_urls(pages, rules)


@query("op6_license_diagonals")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))[0]


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256")
    )


@query("op8_cover_tree_top_k", TOP_K_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_separator_scan", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_tokens FROM documents")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = written(separator_scan.flat_bytes(table(spark, sf_dir, "documents")), group_rows=separator_scan.GROUP_ROWS)
    counts = separator_scan.count_tokens(flat, separator_scan.BYTE_END)
    return counts.join(separator_scan.document_ids(flat), ["file", "doc_no"]).select("doc_id", "n_tokens")


@query("op10_compression_bands")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.judge_documents(docs, compression.fit_rules(docs))


# Each conversation shares its first crc32(id) % 9 turns with the one whose id is the next lower multiple of five.
# CRC-32 (reflected polynomial 0xEDB88320) is folded over the bytes of the decimal id, as DuckDB has no function for it.
TRIE_SQL = """
WITH s AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
               xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                   lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
                       lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM s)),
turns AS (SELECT i.conv_id, s.p, role, text FROM ids i JOIN s ON s.conv_id = i.base AND s.p < i.h UNION ALL SELECT i.conv_id, s.p, role, text FROM ids i JOIN s ON s.conv_id = i.conv_id AND s.p >= i.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, md5(concat(strlen(role), ':', role, text)) AS t, strlen(text) AS n_bytes FROM turns),
paths AS (SELECT conv_id, depth, string_agg(t, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, n_bytes FROM placed
          UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
upward AS (SELECT conv_id, depth, path, n_bytes, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
nodes AS (SELECT path, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
                 sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM upward GROUP BY path, depth),
kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT u.path, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
          FROM nodes n JOIN upward u ON u.conv_id = n.conv_id AND u.depth <= n.depth LEFT JOIN kids k ON k.path = n.path GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes parent ON n.depth > 0 AND parent.path = n.up
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.share_beginnings(turns, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, range(-4, 5))
    return prefix_trie.build_trie(*rebuilt)


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(table(spark, sf_dir, "documents"), byte_level, pieces)[0]


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_documents(docs, net).withColumn("held_out", held_out)
