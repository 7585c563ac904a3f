"""The queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 on instruction data, where the limit on loss-bearing tokens binds."""
    from millrace.llm.packing import pack_conversations

    return pack_conversations(_table(spark, sf_dir, "conversations"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_files import token_file_digest

    return token_file_digest(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lm import Settings, score_documents

    return score_documents(_table(spark, sf_dir, "documents"), Settings(order=3, least=2))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import warc_digest

    return warc_digest(_table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.topk import quantized, top_k

    vectors = quantized(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import spelling

    return spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(_table(spark, sf_dir, "documents")))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.repair import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scores": op5_lm_scores,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_topk": op8_topk,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
    "packed_conversations": packed_conversations,
}

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The other operators have no SQL form (tokenizer, models, automata, hashes); their tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS b, max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, b AS payload_bytes, sha1(h) AS payload_digest,
            CASE WHEN b >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN b >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM m""",
    "op8_topk": """
        WITH ok AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM ok),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
        r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
