"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashplan.llm import (
    chat,
    decontamination,
    language,
    packing,
    pii,
    quality,
    resampling,
    secret_scan,
    simhash,
    tokens,
    top_k,
    toxicity,
    whitening,
)
from cashplan.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: For tests and trials only: whoever has it can undo the pseudonyms. A deployment sets ``PII_KEY``.
TEST_KEY = b"a key that a deployment would take from its secret store"
PII_KEY = "spark.cashplan.pii.key"
QUERY_EVERY = 50


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms, from the session's setting ``PII_KEY``; unset, the test key, with a warning."""
    named = spark.conf.get(PII_KEY, None)
    if not named:
        warnings.warn(f"{PII_KEY} is not set: pseudonyms by the test key can be undone by anyone", stacklevel=2)
    return named.encode() if named else TEST_KEY


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii_key(spark))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.fit(docs))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = top_k.whole(table(spark, sf_dir, "embeddings"))
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


def quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def decontamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long does not hold is null; the operator has it as a decimal."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows, one turn each, and conversation -1, which is a record of another layout."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"),
    )
    records = chat.table_records(table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat.read_back(chat.formatted(chat.canonical_turns(records)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_duplicates": simhash_near_duplicates,
        "op2_token_counts": token_counts,
        "op3_toxicity_chain": toxicity_chain,
        "op4_secret_scan": secret_spans,
        "op5_pii_pseudonyms": pii_pseudonyms,
        "op6_language_id": language_id,
        "op7_exact_top_k": exact_top_k,
        "op8_quality_votes": quality_votes,
        "op9_decontamination": decontamination_hits,
        "op10_best_fit_packing": best_fit_packing,
        "op11_embedding_whitening": embedding_whitening,
        "op12_importance_resampling": importance_resampling,
        "op13_chat_formatting": chat_formatting,
    }


_SECRET_RULES = (
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
_RAW = "\n  UNION ALL\n".join(
    f"""  SELECT r, '{name}' AS kind, {i} AS nth, regexp_extract_all(text, '{pattern}') AS found,
    string_split_regex(text, '{pattern}') AS gaps,
    list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x) >= {least}) AS kept
  FROM docs"""
    for i, (name, pattern, group, least) in enumerate(_SECRET_RULES)
)
SECRET_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
{_RAW}
),
spans AS (
  SELECT r, kind, nth, length(found[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM raw) WHERE kept[i]
),
texts AS (SELECT *, concat_ws(':', kind, start::BIGINT, (start + size)::BIGINT) AS span FROM spans)
SELECT doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, nth), '') AS spans,
  count(*) FILTER (kind = 'pem') AS n_pem,
  count(*) FILTER (kind = 'jwt') AS n_jwt
FROM docs LEFT JOIN texts USING (r) GROUP BY r, doc_id
"""

TOP_K_SQL = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""


def _sql_words(text: str) -> str:
    lower = "translate(coalesce(%s, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" % text
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_sql_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT *, least(13, len(w)) AS k FROM items WHERE len(w) > 0))
),
found AS (
  SELECT r, i, k, item
  FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
              FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k))
  JOIN windows USING (k, win)
),
hits AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r
),
matched AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN matched USING (r)
"""


#: CRC-32 has no function in DuckDB: a table of what eight shifts make of each byte, and a fold over a word's bytes.
RESAMPLING_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
shifts AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS shifted
  FROM (SELECT unnest(range(256)) AS i)
),
of_docs AS (SELECT r, unnest(w) AS word FROM docs),
of_benchmark AS (SELECT unnest({_sql_words('text')}) AS word FROM benchmark),
words AS (SELECT word FROM of_docs UNION SELECT word FROM of_benchmark),
bucketed AS (
  SELECT word, xor(list_reduce(
      list_transform(range(0, octet_length(encode(word))::BIGINT), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT),
      lambda c, b: xor(shifted[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM words, shifts
),
source AS (SELECT bucket, count(*) AS n FROM of_docs JOIN bucketed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM of_benchmark JOIN bucketed USING (word) GROUP BY bucket),
sizes AS (
  SELECT (SELECT coalesce(sum(n), 0) + 10000 FROM source)::DOUBLE AS source_all,
    (SELECT coalesce(sum(n), 0) + 10000 FROM target)::DOUBLE AS target_all
),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(target.n, 0) + 1)::DOUBLE * source_all / ((source.n + 1)::DOUBLE * target_all))) AS gain
  FROM source LEFT JOIN target USING (bucket), sizes
),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM of_docs JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
),
ranks AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (SELECT r, rank FROM ranks WHERE rank <= 10 * n // 100) USING (r)
"""

_ESCAPED = rf"regexp_replace(%s, '{chat.CONTROL}', '\1\\\2\3', 'g')"
_MARKS = " ".join(f"WHEN '{role}' THEN {sum(map(len, marks))}" for role, marks in chat.MARKS.items())
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, conv_id = -1 AND role = 'assistant', role, text) AS nth
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED % 'text'}) + CASE role {_MARKS} ELSE length({_ESCAPED % 'role'}) + {sum(map(len, chat.OTHER_MARKS))} END)::BIGINT
    AS formatted_chars
FROM placed GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_scan": SECRET_SQL,
        "op7_exact_top_k": TOP_K_SQL,
        "op9_decontamination": DECONTAMINATION_SQL,
        "op12_importance_resampling": RESAMPLING_SQL,
        "op13_chat_formatting": CHAT_SQL,
    }
