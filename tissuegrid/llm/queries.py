"""One query per operator over the whole of its table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.llm import (
    byte_bpe, fingerprints, infill, language, lexical, licenses, line_dedup, metric_tree, near_dedup, packing, token_counts, toxicity,
    vector_dedup)
from tissuegrid.llm.common import table

#: Vocabulary files; every operator takes the path as an argument.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Longest document, in tokens, that fits one training sequence.
TOKEN_LIMIT = 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document (``doc_id``) and every raw page (``page_id``)."""
    docs = language.document_evidence(table(spark, folder, "documents"))
    pages = language.page_evidence(table(spark, folder, "pages"))
    rows = docs.unionByName(pages, allowMissingColumns=True)
    return language.identify(rows, ["doc_id", "page_id"])


@_query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's cleaned text with the offsets of what was removed."""
    cleaned = line_dedup.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_chars", "text", "removed")


@_query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@_query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@_query
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@_query
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, folder, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@_query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_BPE)


@_query
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"))


@_query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@_query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@_query
def op11_metric_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows by integer inner product for every fiftieth vector."""
    return metric_tree.top_k(table(spark, folder, "embeddings"))


@_query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form and cut lengths of every document, with digests of the output and of the text rebuilt from it."""
    made = infill.restore(infill.fill_in_middle(table(spark, folder, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


@_query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op4_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), elements AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS MATERIALIZED (
    SELECT p.doc_id AS a, q.doc_id AS b FROM elements p JOIN elements q ON p.x = q.x AND p.doc_id < q.doc_id
    GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), ways AS MATERIALIZED (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION SELECT r.node, e.b FROM reach r JOIN ways e ON e.a = r.seen
), least AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON l.node = s.doc_id
"""

ORACLES["op8_embedding_dedup"] = """
WITH RECURSIVE vectors AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), usable AS (
    SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id <> q.vec_id
    AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), reach AS (
    SELECT vec_id AS node, vec_id AS seen FROM vectors
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM vectors v JOIN least l ON l.node = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""

ORACLES["op11_metric_tree"] = """
WITH usable AS MATERIALIZED (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents
), drawn AS (
    SELECT doc_id, t, w, len(w) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
        ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM cut
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parted AS (
    SELECT doc_id, n, form, t, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
        array_to_string(w[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parted
"""

ORACLES["op13_lexical_search"] = r"""
WITH held AS MATERIALIZED (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tallied AS MATERIALIZED (
    SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS n FROM held GROUP BY doc_id, term
), sizes AS (
    SELECT count(DISTINCT doc_id) AS docs, sum(tf)::BIGINT AS len FROM tallied
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tallied, sizes GROUP BY term, docs
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
    FROM asked JOIN tallied USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
