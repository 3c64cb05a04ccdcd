"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.llm import bpe, chat, hard_negatives, jaccard_join, media_audio, packing, quality_classifier, quality_rules, secret_scan, simhash, spelling, toxicity, url_filter

ROOT = str(Path(__file__).resolve().parents[2])
#: Documents can be long: few rows an Arrow batch keep a Python worker's memory low.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prepared(spark: SparkSession) -> None:
    """Let Python workers find this package where it is installed by path alone, and keep Arrow batches small."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if spark.conf.get(BATCH_KEY, None) in (None, "10000"):
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]


def over(name: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query over one whole table."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return wraps(f)(lambda spark, sf_dir: f(table(spark, sf_dir, name), spark, sf_dir))

    return wrap


@over("documents")
def op1_bpe(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer("word_bpe_49k.json"))


@over("documents")
def op2_toxicity(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(docs, table(spark, sf_dir, "labels"))


@over("documents")
def op3_quality_rules(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(docs)


@over("documents")
def op4_quality_classifier(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(docs, table(spark, sf_dir, "labels"))


@over("documents")
def op5_media_audio(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.digests(docs)


@over("pages")
def op6_url_filter(pages: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages, url_filter.default_list(pages))


@over("documents")
def op7_simhash(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(docs)


@over("documents")
def op8_packing(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


@over("documents")
def op9_secret_scan(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(docs)


@over("conversations")
def op10_chat_rotation(conversations: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(conversations)


@over("embeddings")
def op11_hard_negatives(vectors: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.candidates(vectors.withColumn("label", moved)), F.col("id") % 50 == 0)


@over("documents")
def op12_jaccard_join(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(docs, words=3, percent=90)


@over("documents")
def op13_spelling_variants(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(docs)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_toxicity, op3_quality_rules, op4_quality_classifier, op5_media_audio,
        op6_url_filter, op7_simhash, op8_packing, op9_secret_scan, op10_chat_rotation,
        op11_hard_negatives, op12_jaccard_join, op13_spelling_variants,
    )
}


def _rule_case(column: str) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    value = {"rule": lambda v, h, p: h + p, "verdict": lambda v, h, p: v}[column]
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in rules
    ) + " END"


_LABELS = ", ".join(f"'{x}'" for x in url_filter.BAD_LABELS)
URL_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_extract(rest, '^[^?#]*'), '/.*$', 0, 's') AS path FROM a),
bad AS (SELECT DISTINCT array_to_string(p[k:], '.') AS entry FROM (
          SELECT p, list_position(list_transform(p, lambda x: x IN ({_LABELS})), true) AS k FROM (SELECT string_split(host, '.') AS p FROM b)) WHERE k > 0),
s AS (SELECT DISTINCT host FROM (SELECT host, unnest(generate_series(1, len(string_split(host, '.')))) AS k FROM (SELECT DISTINCT host FROM b)) AS h
      JOIN bad ON array_to_string(string_split(h.host, '.')[k:], '.') = bad.entry)
SELECT page_id, host, path, {_rule_case("rule")} AS rule,
       coalesce({_rule_case("verdict")}, CASE WHEN host IN (SELECT host FROM s) THEN 'block' ELSE 'allow' END) AS verdict
FROM b
"""

ORACLES: dict[str, str] = {
    "op6_url_filter": URL_SQL,
    "op10_chat_rotation": chat.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_jaccard_join": jaccard_join.ORACLE,
}
