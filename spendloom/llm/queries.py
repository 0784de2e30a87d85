"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import (
    ann_blocks, decontaminate, html_text, language_id, merkle_manifest, piece_fst, quality, secrets_scan, simhash,
    substring_dedup, target_sampling, token_counts, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op2_ann_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann_blocks.nearest(vectors, vectors.where("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = substring_dedup.repeated_passages(documents)
    return found.drop("version").withColumnRenamed("id", "doc_id").withColumnRenamed("first_id", "first_doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


def op9_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return piece_fst.encoded(documents, token_counts.vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.secrets(table(spark, sf_dir, "documents"), *secrets_scan.vocabulary(), keep=["doc_id"])
    return secrets_scan.digest_columns(found)


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_sampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest.build(
        table(spark, sf_dir, "documents"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
        changed={"text": merkle_manifest.lowered(F.col("text"))},
    )
    proof = F.sha2(F.array_join(F.flatten("siblings"), ""), 256)
    found = merkle_manifest.witnesses(manifest)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": op1_html_text,
        "op2_ann_blocks": op2_ann_blocks,
        "op3_language_id": op3_language_id,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality": op7_quality,
        "op8_token_counts": op8_token_counts,
        "op9_piece_fst": op9_piece_fst,
        "op10_toxicity": op10_toxicity,
        "op11_secrets_scan": op11_secrets_scan,
        "op12_target_sampling": op12_target_sampling,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


#: The components are summed in their order on both sides, so scores are equal to the last bit.
OP2_SQL = """
WITH usable AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), lambda a, b: a + b) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: The same alignments from joins on the words themselves instead of on hashes.
OP5_SQL = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D -/:-@\[-`{-~]+'), lambda x: x <> '') AS w
    FROM documents
    UNION ALL
    SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D -/:-@\[-`{-~]+'), lambda x: x <> '') FROM benchmark),
long AS (SELECT DISTINCT side, id, w FROM words WHERE len(w) >= 8),
places AS (SELECT side, id, w, unnest(range(1, len(w) - 6)) AS i FROM long),
keyed AS (
    SELECT side, id, i, 0 AS m, [w[i], w[i + 1], w[i + 2], w[i + 4], w[i + 5]] AS k FROM places
    UNION ALL SELECT side, id, i, 1, [w[i], w[i + 1], w[i + 3], w[i + 5], w[i + 6]] FROM places
    UNION ALL SELECT side, id, i, 2, [w[i], w[i + 2], w[i + 3], w[i + 4], w[i + 7]] FROM places),
hits AS (
    SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - b.i AS start
    FROM keyed d JOIN keyed b ON d.side = 'd' AND b.side = 'b' AND d.m = b.m AND d.k = b.k),
aligned AS (
    SELECT doc_id, item_id, start,
           list_transform(range(1, len(b.w) + 1), lambda k: CASE WHEN start + k >= 1 AND d.w[start + k] = b.w[k] THEN 1 ELSE 0 END) AS agree
    FROM hits JOIN long d ON d.side = 'd' AND d.id = doc_id JOIN long b ON b.side = 'b' AND b.id = item_id),
found AS (
    SELECT doc_id, item_id, start, list_sum(agree) AS matched, len(agree) AS words
    FROM aligned
    WHERE list_max(list_transform(range(1, len(agree) - least(13, len(agree)) + 2), lambda s: list_sum(agree[s:s + least(13, len(agree)) - 1])))
          >= 0.8 * least(13, len(agree)))
SELECT doc_id, item_id, CAST(arg_max(start, matched * 1000000000 - start) AS INTEGER) AS start,
       CAST(max(matched) AS INTEGER) AS matched, CAST(words AS INTEGER) AS words
FROM found GROUP BY doc_id, item_id, words
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Byte table of crc32 with the reflected polynomial 0xEDB88320, and the checksum of a text ``{}`` by it.
_CRC_TABLE = """
crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, 2 * strlen({0}), 2), lambda i: ('0x' || hex(encode({0}))[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"""

OP12_SQL = rf"""
WITH {_CRC_TABLE},
docs AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
words AS (
    SELECT row, unnest(w) AS word FROM docs
    UNION ALL
    SELECT 0, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bucketed AS (SELECT word, {_CRC.format("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc),
counts AS (
    SELECT bucket, count(*) FILTER (row > 0) AS s, count(*) FILTER (row = 0) AS t
    FROM words JOIN bucketed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE + 10000 AS all_s, sum(t)::DOUBLE + 10000 AS all_t FROM counts),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * all_s) / ((s + 1)::DOUBLE * all_t))) AS BIGINT) AS gain
    FROM counts, sums),
weights AS (
    SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
    FROM words JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE row > 0 GROUP BY row),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM docs LEFT JOIN weights USING (row)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree level by level: nodes of each level with the digests before and after them in their run."""
    out = []
    for k in range(levels + 1):
        below = f"{name}_{k - 1}"
        source = leaves if not k else (
            f"SELECT tree, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d "
            f"FROM {below} GROUP BY tree, pos // 8"
        )
        out.append(f"""
{name}_{k} AS (
    SELECT tree, pos, d, count(*) OVER (PARTITION BY tree) AS n,
           coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
           coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
    FROM ({source}) WINDOW run AS (PARTITION BY tree, pos // 8 ORDER BY pos))""")
    return ",".join(out)


def _way_up_sql(name: str, start: str, levels: int) -> str:
    """CTEs that carry ``proof`` and ``folded`` of the rows of ``start`` up a tree, one level at a time."""
    out = []
    for k in range(levels):
        before = start if not k else f"{name}_up_{k - 1}"
        out.append(f"""
{name}_up_{k} AS (
    SELECT l.* EXCLUDE (proof, folded), CASE WHEN x.n = 1 THEN proof ELSE proof || pre || post END AS proof,
           CASE WHEN x.n = 1 THEN folded ELSE sha256(pre || folded || post) END AS folded
    FROM {before} l JOIN {name}_{k} x ON x.tree = l.{name}_tree AND x.pos = l.{name}_pos // {8**k})""")
    return ",".join(out)


def _leaf_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


#: Up to 8^7 documents of one language, and 8^3 languages.
OP13_SQL = f"""
WITH {_CRC_TABLE},
hashed AS (
    SELECT doc_id, coalesce('=' || lang, '') AS groups_tree, {_leaf_sql("text")} AS leaf,
           CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOWER.format("text"))} END AS other
    FROM documents, crc),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY groups_tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS groups_pos,
           '' AS proof, coalesce(other, leaf) AS folded
    FROM hashed),
{_tree_sql("groups", "SELECT groups_tree AS tree, groups_pos AS pos, leaf AS d FROM leaves", 7)},
{_tree_sql("top", "SELECT 'top' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, d FROM groups_7", 3)},
places AS (SELECT tree AS groups_tree, 'top' AS top_tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS top_pos, d AS subroot FROM groups_7),
{_way_up_sql("groups", "leaves", 7)},
placed AS (SELECT * FROM groups_up_6 JOIN places USING (groups_tree)),
{_way_up_sql("top", "placed", 3)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified
FROM top_up_2, top_3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ann_blocks": OP2_SQL,
        "op5_decontamination": OP5_SQL,
        "op12_target_sampling": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
