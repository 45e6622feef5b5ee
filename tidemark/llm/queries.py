"""The corpus operators as registered queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitsliced import top_k
from .clusters import clustered
from .codes import compressed
from .common import table
from .decontamination import contaminated
from .language import language_of_documents
from .neardup import near_duplicates
from .packing import packed
from .passages import repeated_passages
from .pii import personal_data_of_documents
from .quality import quality_of_documents
from .sequences import round_trip
from .simhash import simhash_near_duplicates
from .toxicity import toxicity_of_documents


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op2_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_of_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_sliced_top_k": op1_bit_sliced_top_k,
    "op2_token_sequences": op2_token_sequences,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality": op10_quality,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_vector_codes": op13_vector_codes,
}

WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: floor(1024 * x) of every vector that takes part, as doubles, in which sums and products of them are exact.
KEPT = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _squared(a: str, b: str) -> str:
    return f"list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b})"


def _lloyd_sql(rounds: int = 10) -> str:
    steps = ["v AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT vec_id, " + KEPT + "))", "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w FROM v ORDER BY 1 LIMIT 8)"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {_squared('v', 'w')}, c := c)) AS b FROM v, c{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT b.c AS c, unnest(range(1, 65)) AS k, unnest(v) AS x FROM v JOIN a{i} USING (r))")
            steps.append(f"m{i} AS (SELECT c, k, floor(sum(x) / count(*)) AS m FROM s{i} GROUP BY c, k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n, w) AS w FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY k) AS n FROM m{i} GROUP BY c) USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, b.c::INTEGER AS cluster, b.d::BIGINT AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON c = b.c"""


def _codes_sql(rounds: int = 4) -> str:
    steps = ["v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS r, * FROM (SELECT vec_id, label, " + KEPT + "))", "p AS MATERIALIZED (SELECT r, k AS part, v[16 * k + 1:16 * k + 16] AS v FROM v, range(4) AS g(k))", "c0 AS MATERIALIZED (SELECT part, r AS c, v AS w FROM p WHERE r < 256)"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := {_squared('v', 'w')}, c := c)) AS b FROM p JOIN c{i} USING (part) GROUP BY r, part)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT part, b.c AS c, unnest(range(1, 17)) AS k, unnest(v) AS x FROM p JOIN a{i} USING (r, part))")
            steps.append(f"m{i} AS (SELECT part, c, k, floor(sum(x) / count(*)) AS m FROM s{i} GROUP BY part, c, k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, c, coalesce(n, w) AS w FROM c{i} LEFT JOIN (SELECT part, c, list(m ORDER BY k) AS n FROM m{i} GROUP BY part, c) USING (part, c))")
    steps.append(f"f AS (SELECT r, string_agg(printf('%02x', b.c), '' ORDER BY part) AS code, sum(b.d) AS e FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY part, c)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, e::BIGINT AS error, (sum(e) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h"""


ORACLES: dict[str, str] = {
    "op1_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_minhash_near_dedup": f"""
WITH RECURSIVE
w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.doc_id
""",
    "op12_centroid_clusters": _lloyd_sql(),
    "op13_vector_codes": _codes_sql(),
}
