"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language, mixing, pieces, quality_knn, quality_rules, secrets, sharding
from .fingerprint import edited_fingerprints
from .near_dup import near_duplicates
from .samples import fold
from .storage import Scratch

#: Where the public vocabulary files lie; a parameter of every function that needs one.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = [f"shard-{k:03d}" for k in range(256)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _held_out(folds: int, which: int):
    return F.coalesce(fold(F.col("doc_id"), folds) == which, F.lit(False)).alias("held_out")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    found = pieces.encode(docs, pieces.load(model), check=True)
    return found.select("doc_id", "n_chars", F.size("ids").alias("n_ids"), "ids", "round_trip")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; null ids come after all others."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_fingerprints(docs, _parts(spark))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shingle count, its component of links of 75 % or more, and whether it is the least id there."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Scratch(spark, "near-dup"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from documents of three folds of four that have an id and a language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _held_out(4, 2))
    model = language.train(docs.where("not held_out and doc_id is not null"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans with those that the models add."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's cell, tokens, probability and draw under the raked mixture."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = mixing.mixture(docs, Scratch(spark, "mixing"))
    return found.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), "probability", "sampled"
    )


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from labels of four folds of five."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", _held_out(5, 0))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), _held_out(5, 0))
    model = quality_knn.train(docs, labels.where("not held_out and doc_id is not null"))
    return quality_knn.predict(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's statistics, the base rules' verdict and the weakly supervised one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, Scratch(spark, "rules"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op10_sharding(spark: SparkSession, sf_dir: str, shards: list[str] | None = None) -> DataFrame:
    """Each document's slot and shard."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign(docs, shards or SHARDS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_fingerprints, op3_near_dedup, op4_language_id, op5_secret_scan, op6_source_mixing,
        op7_quality_knn, op8_quality_rules, op9_html_text, op10_sharding,
    )
}

#: Links of 75 % on five-word shingle sets and their components, by counting common shingles.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, linked.b FROM reach JOIN linked ON linked.a = reach.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

#: Queries without an entry depend on trained models, hashes or pieces that SQL doesn't have; brute force tests them.
ORACLES = {"op3_near_dedup": NEAR_DEDUP_SQL}


def sharding_sql(shards: list[str] | None = None) -> str:
    """Placement by the table's slots; the table itself is given as a list, and tests hold it against its definition."""
    table = sharding.lookup_table(shards or SHARDS).tolist()
    names = ", ".join(f"'{s}'" for s in shards or SHARDS)
    return f"""
    SELECT doc_id, source, n_chars, slot::INT AS slot, names[places[slot + 1] + 1] AS shard
    FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(table)} AS slot FROM documents),
         (SELECT [{names}] AS names, {table}::SMALLINT[] AS places)"""


def oracles() -> dict[str, str]:
    return ORACLES | {"op10_sharding": sharding_sql()}
