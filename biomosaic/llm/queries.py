"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .clustering import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED, cluster_vectors
from .decontamination import WIDTH, decontaminate
from .exact_dedup import exact_dedup
from .language_id import language_id
from .mixing import mix
from .near_vectors import near_vectors
from .packing import pack
from .resampling import resample
from .runtime import read
from .secret_scan import secret_scan
from .shingle_join import shingle_join
from .substring_dedup import substring_dedup
from .suffix_tree_lm import suffix_tree_lm
from .toxicity import toxicity

#: Vocabulary of the packing query; pack() takes any file's path.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), TOKENIZER)


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(read(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm(read(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which uses this module's tokenizer

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": _pipeline,
    "op1_language_id": _op1,
    "op2_exact_dedup": _op2,
    "op3_substring_dedup": _op3,
    "op4_secret_scan": _op4,
    "op5_toxicity": _op5,
    "op6_mixing": _op6,
    "op7_packing": _op7,
    "op8_shingle_join": _op8,
    "op9_suffix_tree_lm": _op9,
    "op10_near_vectors": _op10,
    "op11_decontamination": _op11,
    "op12_resampling": _op12,
    "op13_clustering": _op13,
}

#: The words of operators 11 and 12, of a text lower-cased in A-Z.
_WORDS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


def _rounds() -> str:
    """Assignments and moved centroids, one pair of views a round."""
    views = []
    for i in range(ROUNDS + 1):
        views.append(f"""
        a{i} AS MATERIALIZED (
            SELECT row, min(distance) AS distance, arg_min(cluster, distance * {CLUSTERS} + cluster) AS cluster
            FROM (SELECT row, cluster, list_sum(list_transform(
                      list_zip(k.point, c.point), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS distance
                  FROM kept k, c{i} c)
            GROUP BY row)""")
        if i < ROUNDS:
            views.append(f"""
        m{i} AS (
            SELECT cluster, place, (total - ((total % n) + n) % n) // n AS x
            FROM (SELECT cluster, place, sum(point[place])::HUGEINT AS total, count(*)::HUGEINT AS n
                  FROM a{i} JOIN kept USING (row), (SELECT unnest(range(1, {DIMENSIONS + 1})) AS place)
                  GROUP BY cluster, place)),
        c{i + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(moved, point) AS point
            FROM c{i} LEFT JOIN (SELECT cluster, list(x::BIGINT ORDER BY place) AS moved FROM m{i} GROUP BY cluster) USING (cluster))""")
    return ",".join(views)


ORACLES = {
    "op11_decontamination": f"""
        WITH texts AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least({WIDTH}, len(w)) AS size, w[start : start + least({WIDTH}, len(w)) - 1] AS run
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS start FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        runs AS (
            SELECT row, start, size, w[start : start + size - 1] AS run
            FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM texts, sizes WHERE len(w) >= size)),
        found AS (SELECT row, start, size, item_id FROM runs JOIN windows USING (size, run)),
        hits AS (
            SELECT row, count(DISTINCT place) AS n_hit
            FROM (SELECT row, unnest(range(start, start + size)) AS place FROM found) GROUP BY row),
        listed AS (
            SELECT row, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN hits USING (row) LEFT JOIN listed USING (row)""",
    "op13_clustering": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS point
            FROM embeddings
            WHERE len(embedding) = {DIMENSIONS}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
        c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), point) - 1)::INTEGER AS cluster, point
            FROM kept QUALIFY cluster < {CLUSTERS}),{_rounds()},
        sums AS (SELECT cluster, sum(distance) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
        SELECT vec_id, cluster, distance::BIGINT AS distance, cluster_inertia::BIGINT AS cluster_inertia,
               (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia,
               sha256(array_to_string(c.point, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN kept USING (row) JOIN sums USING (cluster) JOIN c{ROUNDS} c USING (cluster)""",
    "op2_exact_dedup": """
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
}
