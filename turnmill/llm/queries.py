"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, impact_topk, jaccard_join, line_dedup, part_codes, passage_dedup, quality_mil, source_mix, token_align, token_count, token_files, vector_dedup, warc_zst
from .common import table


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_documents(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.read(spark, warc_zst.write(table(spark, sf_dir, "pages")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.digest(table(spark, sf_dir, "documents"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.search(table(spark, sf_dir, "embeddings"))


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_quality_mil, op3_source_mix, op4_token_count, op5_token_files, op6_warc_zst, op7_exact_dedup, op8_jaccard_join, op9_vector_dedup, op10_line_dedup, op10_passage_dedup, op11_token_align, op12_impact_topk, op13_part_codes)
}

def _finite(scale: int) -> str:
    """Vectors without null or non-finite components, as lists of whole numbers."""
    return f"""
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _codes_sql(rounds: int = part_codes.ROUNDS) -> str:
    """The rounds of operator 13, each distance worked out."""
    cut = lambda x: f"list_slice({x}, part * len({x}) // 4 + 1, (part + 1) * len({x}) // 4)"
    out = f"""
        WITH v AS MATERIALIZED ({_finite(1024)}),
        p AS MATERIALIZED (SELECT vec_id, part, {cut("x")} AS x FROM v, range(4) r(part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),"""
    for r in range(rounds + 1):
        out += f"""
        n{r} AS MATERIALIZED (
            SELECT vec_id, p.part, min((list_inner_product(p.x, p.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x))::BIGINT * 256 + entry) AS best
            FROM p JOIN b{r} b ON p.part = b.part GROUP BY vec_id, p.part),"""
        if r < rounds:
            out += f"""
        m{r} AS (SELECT part, entry, list(mean ORDER BY pos) AS x FROM (
            SELECT p.part, best % 256 AS entry, pos, floor(sum(p.x[pos]) / count(*)) AS mean
            FROM p JOIN n{r} USING (vec_id, part), range(1, len(p.x) + 1) r(pos) GROUP BY ALL) GROUP BY ALL),
        b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry),"""
    return out + f"""
        c AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM n{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM c JOIN v USING (vec_id)"""


ORACLE: dict[str, str] = {
    "op12_impact_topk": f"""
        WITH v AS MATERIALIZED ({_finite(256)}),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op13_part_codes": _codes_sql(),
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op6_warc_zst": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        u AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS owner FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM u""",
}
