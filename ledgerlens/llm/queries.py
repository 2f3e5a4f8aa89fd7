"""Registered queries of the operators: each over its whole table, with the
parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import chat, exact, langid, lexical, metric, mixing, packing, pages, phrases, simhash, suffixes, tokens, variants
from ledgerlens.llm.common import load
from ledgerlens.session import scratch_path


def op1_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.top_products(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(docs).select("doc_id", "language", "posterior", "accepted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                        suffixes.decoded().alias("text"), F.length("kept").cast("long").alias("n_kept"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_conversation(spark, load(spark, sf_dir, "conversations"))
    back = chat.read_back(chat.format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank_documents(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.deduplicate(load(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "digest-index"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_metric_search, op2_main_text, op3_language_id, op4_simhash, op5_packing, op6_token_counts, op7_mixing,
                                op8_suffix_dedup, op9_fingerprints, op10_chat, op11_lexical_search, op12_spelling_variants, op13_exact_dedup)
}
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op1_metric_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_chat": """
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(text) + 24 + len(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM documents),
        c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d),
        f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, n, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({FOLDED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)""",
}
