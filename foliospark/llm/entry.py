"""The queries of this subpackage, and SQL where DuckDB can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import ann, chat, filter_audit, fingerprints, langid, licenses, packing, pieces, records, repair, simhash, tokencount, toxicity
from foliospark.llm.common import default_vocabulary, table

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
END_ID, SEQUENCE, LIMIT, NEAREST, QUERY_EVERY = 1, 4096, 4096, 20, 20
#: The conversation that op2 adds: its texts hold control strings and a backslash.
ADDED = (-7, "\\### Assistant: </turn> ok")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), default_vocabulary(WORD_TOKENIZER), END_ID)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(ADDED[0], 0, "user", ADDED[1]), (ADDED[0], 1, "assistant", ADDED[1])], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    turns = chat.format_turns(messages.withColumn("parts", parts), parts_column="parts")
    return chat.conversation_digests(chat.write_turns(turns))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEAREST)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), default_vocabulary(PIECE_MODEL))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(WORD_TOKENIZER), END_ID, SEQUENCE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.label_categories()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), default_vocabulary(PIECE_MODEL), LIMIT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair_digest(rows, repair.damaged(rows))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), '<|', '\<|'), ': ', '\: ')"

OP2_SQL = rf"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ADDED[1]}'), (-7, 1, 'assistant', '{ADDED[1]}')
), formatted AS (
  SELECT *, '### ' || {_ESCAPED.format("role")} || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS f FROM messages
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, f)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, f) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(f))::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens, 0::BIGINT AS n_attachments
FROM formatted GROUP BY conv_id"""

OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE fault <> 0
), placed AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER own AS i, lag(left(role, 1)) OVER own AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS (
  SELECT *, last_char = '' AS blank, last_char <> '' AND nth > 1 AS duplicate, last_char <> '' AND nth = 1 AND NOT contains('.!?', last_char) AS truncated FROM placed
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), turns AS (
  SELECT conv_id, i, ini, CASE WHEN blank OR duplicate THEN NULL WHEN truncated THEN 5 ELSE 0 END AS stays FROM faults
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1, {'c': 5::BIGINT, 'a': 'I'} AS s2, {'c': 10::BIGINT, 'a': 'II'} AS s3 FROM sums
  UNION ALL
  SELECT conv_id, i, t0, t1,
    list_min([t2, {'c': t0.c + 5, 'a': t0.a || 'I'}, CASE WHEN t1 IS NOT NULL THEN {'c': t1.c + 5, 'a': t1.a || 'I'} END, {'c': t3.c + 5, 'a': t3.a || 'I'}]),
    list_min([t3, {'c': t2.c + 5, 'a': t2.a || 'I'}, {'c': t0.c + 10, 'a': t0.a || 'II'}, CASE WHEN t1 IS NOT NULL THEN {'c': t1.c + 10, 'a': t1.a || 'II'} END])
  FROM (
    SELECT w.conv_id, t.i, {'c': s0.c + 2, 'a': s0.a || 'D'} AS t0,
      list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D'} END, CASE WHEN ini = 's' AND stays IS NOT NULL THEN {'c': s0.c + stays, 'a': s0.a || 'K'} END]) AS t1,
      list_min([{'c': s2.c + 2, 'a': s2.a || 'D'}, CASE WHEN stays IS NOT NULL THEN list_transform([list_min([s0, s1, s3])], lambda b: {'c': b.c + stays + (ini <> 'u')::BIGINT, 'a': b.a || CASE ini WHEN 'u' THEN 'K' ELSE 'R' END})[1] END]) AS t2,
      list_min([{'c': s3.c + 2, 'a': s3.a || 'D'}, CASE WHEN stays IS NOT NULL THEN {'c': s2.c + stays + (ini <> 'a')::BIGINT, 'a': s2.a || CASE ini WHEN 'a' THEN 'K' ELSE 'R' END} END]) AS t3
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
  )
), chosen AS (
  SELECT w.conv_id, list_min([s0, s3]) AS best FROM walk w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
), edits AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS p FROM chosen WHERE best.a <> ''
), numbered AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER own AS i, count(*) FILTER (e <> 'D') OVER own AS k FROM edits WINDOW own AS (PARTITION BY conv_id ORDER BY p)
), kept AS (
  SELECT n.conv_id, p, e, k, f.role, f.text, coalesce(max(CASE WHEN k = 1 AND e = 'K' AND ini = 's' THEN 1 END) OVER (PARTITION BY n.conv_id), 0) AS shifted
  FROM numbered n LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i AND e <> 'I' WHERE e <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - shifted) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha
  FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS smallest
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN texts.doc_id > smallest THEN 'E' ELSE '' END AS fails
  FROM texts LEFT JOIN marks USING (doc_id)
), counts AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), steps AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), taken AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, good, toxic, n,
    contains(fails, substr(filter_order, step, 1)) AS hit, translate(fails, left(filter_order, step - 1), '') <> fails AS gone
  FROM counts, steps
), summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM taken GROUP BY part, filter_order, step, f
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_chat_format": op2_chat_format,
    "op3_nearest": op3_nearest,
    "op4_fingerprints": op4_fingerprints,
    "op5_pieces": op5_pieces,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_audit": OP13_SQL}
