"""The registered queries of this package: thin digests over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, clustering, decontaminate, exact_dedup, language, licenses, near_dedup, pii, quality, ranking, sharding, toxicity, urls
from brindle.llm.oracles import ORACLES
from brindle.llm.shared import held_out, spread, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = [k.name for k in pii.KINDS if k.base]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined([k.name for k in pii.KINDS]).alias("spans"), F.array_join(F.transform(F.concat(*[F.col(k.name) for k in pii.KINDS]), lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary_path())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 4, 2)
    return language.predict(docs, language.train(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(spread(table(spark, sf_dir, "embeddings")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op13_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
