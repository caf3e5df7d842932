"""One query for each operator: applied with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import ann, bpe, chat, decontamination, html, lm, ngram_jaccard, quality, secrets, sharding
from strandframe.plans.registry import crc32_sql


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chats(rows))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_bpe, op3_html_extraction, op4_quality_classifier, op5_sharding, op6_chat_formatting, op7_benchmark_decontamination, op8_nearest_neighbours,
        op9_secret_scans, op10_lm_scoring,
    )
}

#: Words of a text as the contract cuts them, and their distinct 5-word shingles.
_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"

ORACLES = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
sets AS (SELECT doc_id, {_SHINGLES} AS s FROM words),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
often AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
shared AS (SELECT doc_id, t FROM tokens SEMI JOIN often USING (t)),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shared x JOIN shared y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach r JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id, n
""",
    "op5_sharding": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
keyed AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h, CAST(strlen(t) + 1 AS BIGINT) AS size, {crc32_sql("t")} AS text_crc32 FROM texts),
placed AS (
  SELECT *, row_number() OVER whole - 1 AS place, sum(size) OVER (whole ROWS UNBOUNDED PRECEDING) - size AS before, CAST(sum(size) OVER () AS DOUBLE) AS total, sum(size) OVER (PARTITION BY h) AS together
  FROM keyed WINDOW whole AS (ORDER BY h, doc_id NULLS FIRST, size, text_crc32)),
starts AS (SELECT *, CASE WHEN together <= CAST(0.01 AS DOUBLE) * total / 8 THEN min(before) OVER (PARTITION BY h) ELSE before END AS starts_at FROM placed),
dealt AS (SELECT *, CAST(least(7, floor(CAST(starts_at * 8 AS DOUBLE) / total)) AS INT) AS shard FROM starts)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM dealt
""",
    "op6_chat_formatting": r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, coalesce(role, '') AS r, coalesce(text, '') AS t FROM said),
marked AS (SELECT *, replace(replace(replace(t, '\', '\\'), '###', '\h'), '</turn>', '\t') AS et, replace(replace(replace(replace(r, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS er FROM turns),
ordered AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
    coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '') AS loss, sum(length('### ' || er || ': ' || et || ' </turn>' || chr(10))) AS n
  FROM marked GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM ordered
""",
    "op7_benchmark_decontamination": f"""
WITH words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
item_words AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
docs AS (SELECT doc_id, unnest({_SHINGLES}) AS t FROM words),
items AS (SELECT item_id, unnest({_SHINGLES}) AS t FROM item_words),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared FROM docs JOIN items USING (t) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
""",
}
