"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Stands for a secret that a real run takes from its own key store.
KEY = "not a secret: for tests and checks"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"))


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_on, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on(docs))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, KEY, count="n_entities", kinds="kinds")


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse

    return collapse(table(spark, sf_dir, "conversations"))


SQL["op9_chat"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations
), whole AS (
  SELECT conv_id, any_value(n_turns) AS n, list({'r': role, 't': text} ORDER BY place) AS body FROM turns GROUP BY conv_id
), firsts AS (
  SELECT body, n, min(conv_id) AS conv_id FROM whole GROUP BY body, n
), kept AS (
  SELECT f.conv_id FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.n > f.n AND w.body[1] = f.body[1] AND w.body[1:f.n] = f.body)
)
SELECT conv_id, place, n_turns, role, text,
       '<|' || replace(replace(lower(trim(role)), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) || replace(replace(text, '<|', '<\|'), '|>', '|\>') || '<|end|>' || chr(10) AS rendered
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept)
"""


SQL["op4_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT x, y FROM edges UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x
), least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.y, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l ON s.doc_id = l.x
"""
