"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    bpe,
    chat,
    collocations,
    langid,
    lexical,
    mixing,
    pii,
    repetition,
    simhash,
    token_counts,
    topk,
    toxicity,
    warc,
)
from tabloom.llm.matches import matches

# Edits that the count query applies: runs of digits are masked, runs of blanks cut.
EDITED_RUNS = r"[0-9]{2,}+|\x20{2,}+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    valid, terms, weights = topk.sparse(F.col("embedding"))
    rows = (
        table(spark, folder, "embeddings")
        .filter(valid & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").alias("id"), terms.alias("terms"), weights.alias("weights"))
    )
    return topk.search(rows.filter("id % 50 = 0"), rows, 5)


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    log = chat.log_of_turns(rows.union(extra))
    return chat.read_back(chat.formatted(log, chat.MESSAGE_ORDER))


OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g') AS shown FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[ROLE]') + length(role) + length('[/ROLE]') + length(shown) + length('</s>')
    + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("txt")
    )
    docs = matches(docs, "txt", "runs", EDITED_RUNS, None)
    edits = F.expr(
        "transform(runs, r -> struct(r.start as start, r.end as end, if(startswith(r.found, ' '), ' ', '0') as new))"
    )
    docs = docs.select("doc_id", "txt", edits.alias("edits"))
    counted = token_counts.edited_counts(
        F.col("txt"), F.col("edits"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return docs.select("doc_id", F.size("edits").cast("long").alias("n_edits"), counted.alias("c")).select(
        "doc_id", "n_edits", "c.n_tokens", "c.n_tokens_edited", "c.n_encoded"
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("group_root")


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predictions(docs, langid.fit(docs))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    q = repetition.with_verdict(table(spark, folder, "documents").select("doc_id", "text"))
    return q.select("doc_id", "quality.*").drop("longest_repeat")


OP7 = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, row_number() OVER () AS row
  FROM documents
), b AS (
  SELECT *, len(words) AS n, list_filter(string_split(text, chr(10)),
    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w
), sizes AS (SELECT unnest([{repetition.WINDOW}, {repetition.PASSAGE_WORDS}, {repetition.MAX_REPEAT + 1}]) AS size),
spots AS (
  SELECT row, size, unnest(range(1, CAST(n - size + 2 AS BIGINT))) AS i, words FROM b JOIN sizes ON n >= size
), h AS (
  SELECT row, size, i, array_to_string(words[i:i + size - 1], ' ') AS passage FROM spots
), d AS (
  SELECT row, size, i FROM (SELECT *, count(*) OVER (PARTITION BY row, size, passage) AS c FROM h) WHERE c > 1
), r AS (
  SELECT row, size, count(DISTINCT p) AS covered FROM (
    SELECT row, size, unnest(range(i, CAST(i + size AS BIGINT))) AS p FROM d) GROUP BY row, size
), m AS (
  SELECT b.*, coalesce(r3.covered, 0) AS c3, coalesce(r10.covered, 0) AS c10, coalesce(rl.covered, 0) AS cl
  FROM b LEFT JOIN r r3 ON r3.row = b.row AND r3.size = {repetition.WINDOW}
  LEFT JOIN r r10 ON r10.row = b.row AND r10.size = {repetition.PASSAGE_WORDS}
  LEFT JOIN r rl ON rl.row = b.row AND rl.size = {repetition.MAX_REPEAT + 1}
), f AS (
  SELECT *, n < {repetition.MIN_WORDS} OR 100 * c3 > 50 * n AS base_failed FROM m
)
SELECT doc_id, n AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, c3 AS n_repeat_words,
  c10 AS covered_words, base_failed,
  NOT base_failed AND 100 * c10 <= {repetition.MAX_COVERED} * n AND cl = 0 AS kept
FROM f
"""


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digests(table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


OP10 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM m
"""



def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
t AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY row, term),
q AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM f, s GROUP BY term),
scored AS (SELECT item_id, row, any_value(doc_id) AS doc_id,
  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, row),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {lexical.TOP}
"""


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


OP12 = f"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, size, words[i:i + size - 1] AS ws FROM p, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS size),
  unnest(range(1, CAST(len(words) - size + 2 AS BIGINT))) AS u(i) WHERE len(words) >= size),
f AS (SELECT lang, any_value(size) AS size, ws, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= {collocations.MIN_COUNT}),
c AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS phrase FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
  ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN totals USING (lang), unnest(range(1, size)) AS u(k)
  JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM least s WHERE NOT EXISTS (SELECT 1 FROM c longer
  WHERE longer.lang = s.lang AND longer.a = s.a AND length(longer.phrase) > length(s.phrase) AND contains(longer.phrase, s.phrase)))
SELECT lang, rank::INTEGER AS rank, trim(phrase, ' ') AS phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= {collocations.TOP}
"""


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, folder, "labels")))


QUERIES = {
    "op1_topk_search": (op1_topk_search, OP1),
    "op2_chat_format": (op2_chat_format, OP2),
    "op3_token_counts": (op3_token_counts, None),
    "op4_simhash": (op4_simhash, None),
    "op5_source_mixing": (op5_source_mixing, None),
    "op6_language_id": (op6_language_id, None),
    "op7_quality_rules": (op7_quality_rules, OP7),
    "op8_bpe": (op8_bpe, None),
    "op9_pii": (op9_pii, None),
    "op10_warc": (op10_warc, OP10),
    "op11_lexical_search": (op11_lexical_search, OP11),
    "op12_collocations": (op12_collocations, OP12),
    "op13_toxicity": (op13_toxicity, None),
}
