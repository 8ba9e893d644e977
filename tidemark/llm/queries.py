"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe_pieces, chat_format, exact_dedup, jaccard_join, license_scan, line_dedup, packing, quality, recompression, suffix_groups, vector_index, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.drop_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_groups.drop_repeated_bytes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pieces.digests(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L conv_id, turn, role, '{said}' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)")
    out = chat_format.format_chats(rows.unionByName(more)).withColumn("turns", chat_format.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # the mask itself is cut out, so that a wrong one shows
    cut = F.transform("loss_spans", lambda x: F.substring("formatted", x["start"].cast("int") + 1, x["length"].cast("int")))
    loss = F.array_join(F.transform(cut, chat_format.unescape), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(_read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.near_vectors(_read(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


_OPS = (
    op1_substring_dedup, op2_suffix_dedup, op3_exact_dedup, op4_license_scan, op5_quality_rules, op6_sentencepiece, op7_best_fit_packing,
    op8_chat_format, op9_line_dedup, op10_jaccard_join, op11_whitening, op12_near_vectors, op13_token_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in _OPS}


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH t AS (SELECT doc_id, sha256({_AZ.format("coalesce(text, '')")}) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)
"""

_OP5_SYMBOLS = "[#*$%&|<>]"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_OP5 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wins AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM hit, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
stops AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM t)
  WHERE lower(rtrim(w, '.,;:!?')) IN ({_STOP}) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{_OP5_SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(stops.n, 0)::BIGINT AS n_stop
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN stops USING (doc_id)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_repeat_words / n_words <= 0.3 AND word_chars / n_words BETWEEN 1.5 AND 20.0
       AND n_symbols / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.5
       AND (n_words < 50 OR n_stop / n_words >= 0.02) AS kept
FROM v
"""

_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'))
             + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS n
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _OP3, "op5_quality_rules": _OP5, "op8_chat_format": _OP8}
