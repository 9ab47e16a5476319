"""The thin queries over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import chat, decontaminate, langid, neardup, phrases, pieces, sampling, tokens, toxicity, urls, warc
from pulsegrid.llm.scratch import Scratch


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the package that holds them is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    path = scratch.path("ids")
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return tokens.checksums(tokens.read(spark, path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    files = warc.write_pages(table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return warc.read_pages(files).drop("record_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, train=sampling.fold("doc_id", 3) != 1, runs=False)
    return found.withColumn("held_out", sampling.fold("doc_id", 3) == 1)


#: Listed rules of the URL filter: host, path prefix, verdict. Fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op7_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(table(spark, sf_dir, "conversations"), train=sampling.fold("conv_id", 3) != 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels, train=sampling.fold("doc_id", 4) != 2)
    return found.withColumn("held_out", sampling.fold("doc_id", 4) == 2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_warc": op2_warc,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language_id": op4_language_id,
        "op5_url_filter": op5_url_filter,
        "op6_phrase_fingerprints": op6_phrase_fingerprints,
        "op7_chat_roles": op7_chat_roles,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
    }


#: The word rule of the benchmark contract in SQL.
_WORDS = r"""list_filter(string_split_regex(translate(COALESCE({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP2_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS n, sha1(COALESCE(html, '')) AS d FROM pages),
h AS (SELECT d, MAX(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND n >= 1000
"""

OP10_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
item AS (
  SELECT item_id, 10 AS k, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9
),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
x AS (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k),
hit AS (SELECT doc_id, x.k, i, item_id FROM x JOIN item ON item.k = x.k AND win = array_to_string(w[i:i + x.k - 1], ' ')),
n AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS at FROM hit) GROUP BY doc_id),
l AS (SELECT doc_id, COUNT(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, COALESCE(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other queries have no SQL: learned models, hashes of binary ids, sketches, or all pairs of texts."""
    return {"op2_warc": OP2_SQL, "op10_decontamination": OP10_SQL}
