"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayscope.llm import audit, decontam, hilbert, hnsw, langid, lexical, minhash, mixing, quality, substring, urlfilter, warc, wrapper
from assayscope.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "index_position", "intact")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.pareto_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.selectExpr("doc_id", "mix_size AS size", "mix_source_size AS source_size", "mix_target AS target", "mix_taken AS taken")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of a document that leaks a benchmark item."""
    out = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", "length", "similarity")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(table(spark, sf_dir, "documents"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_quality, op2_substring, op3_warc, op4_langid, op5_vectors, op6_mix, op7_decontam, op8_urls, op9_minhash, op10_html]
    found += [op11_lexical, op12_hilbert, op13_audit, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    found = {"op2_substring": SUBSTRING_SQL, "op3_warc": warc.ORACLE, "op6_mix": mixing.ORACLE, "op8_urls": urlfilter.ORACLE}
    return found | {"op11_lexical": lexical.ORACLE, "op12_hilbert": hilbert.ORACLE, "op13_audit": audit.ORACLE}


#: Only sound on unique ids, which the driver's tables have.
SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY h),
hit AS (SELECT k.doc_id, p FROM k JOIN f USING (h) WHERE first_doc < k.doc_id),
cut AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
gone AS (SELECT doc_id, list(i) AS cuts FROM cut GROUP BY doc_id),
j AS (SELECT w.doc_id, w.w, coalesce(cuts, []) AS cuts FROM w LEFT JOIN gone USING (doc_id)),
r AS (SELECT doc_id, w, cuts, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN NOT list_contains(cuts, i) THEN w[i] END), lambda x: x IS NOT NULL), ' ') AS kept FROM j)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(cuts) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r
"""
