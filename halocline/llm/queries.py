"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halocline.llm import conversations, decontaminate, language, main_text, matroska, merkle, mixing, repeats, sharding, simhash, toxicity, url_filter, warc

Runner = Callable[[SparkSession, str], DataFrame]


def _over(function, *tables: str) -> Runner:
    return lambda spark, sf_dir: function(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Runner] = {
    "op1_substring_dedup": _over(repeats.repeats_digest, "documents"),
    "op2_simhash": _over(simhash.near_duplicate_digest, "documents"),
    "op3_warc": _over(warc.archive_round_trip, "pages"),
    "op4_language": _over(language.language_digest, "documents"),
    "op5_toxicity": _over(toxicity.toxicity_digest, "documents", "labels"),
    "op6_matroska": _over(matroska.media_digest, "documents"),
    "op7_decontamination": _over(decontaminate.find_leaks, "documents", "benchmark"),
    "op8_sharding": _over(sharding.shard_digest, "documents"),
    "op9_mixing": _over(mixing.mix_digest, "documents"),
    "op10_url_filter": _over(url_filter.judge_urls, "pages"),
    "op11_merkle": _over(merkle.merkle_manifest, "documents"),
    "op12_conversations": _over(conversations.repair_conversations, "conversations"),
    "op13_main_text": _over(main_text.extract_main_text, "pages"),
}

SUBSTRING_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM words, unnest(range(1, len(w) - 11)) t(i)),
firsts AS (SELECT k, min(doc_id) AS first FROM placed GROUP BY k HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM placed JOIN firsts USING (k) WHERE first < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM covered GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, coalesce(len(js), 0) AS r,
    CASE WHEN js IS NULL THEN w ELSE [x[1] for x in list_zip(w, range(1, len(w) + 1)) if NOT list_contains(js, x[2])] END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

SQL: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op3_warc": warc.WARC_SQL, "op9_mixing": mixing.MIX_SQL, "op10_url_filter": url_filter.URL_SQL, "op11_merkle": merkle.MERKLE_SQL, "op12_conversations": conversations.CONVERSATION_SQL}
