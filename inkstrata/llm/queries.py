"""The operators of this package as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, decontaminate, langid, licenses, lmscore, media, pack, runs, simhash, sitetree, tokencount, trie
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern())


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), langid.fold("doc_id", 5) != 1)


def op4_rotate_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = media.described(media.media_of(docs)).drop("media")
    found = media.sequence(media.pages_of(docs), stored).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", *[f.split()[0] for f in media.FEATURES.split(", ")], "position", "caption")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.fold("doc_id", 3) == 1
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), F.col("language")["lang"].alias("lang_pred"), F.col("language")["score"].alias("score"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Alone on its executors, which have room for larger slices: fewer words are encoded anew.
    return pack.report(pack.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), slice_bytes=pack.BATCH_BYTES))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.report(bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep_ids=False))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.runs(runs.planted(table(spark, sf_dir, "documents"))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"), graft=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_section_tokens, op3_lm_score, op4_rotate_chat, op5_media_columns, op6_main_text, op7_license_scan, op8_language, op9_pack, op10_simhash)
    found = (*found, op11_best_fit, op12_periodic_runs, op13_prefix_trie)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    found = {"op1_decontaminate": OP1_SQL, "op4_rotate_chat": chat.ROTATE_SQL, "op7_license_scan": licenses.scan_sql(), "op13_prefix_trie": trie.TRIE_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
