"""The registered queries of this package, one for each operator, and the SQL they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import pin_utc, shared_folder
from . import bpe, decontaminate, divergence, licenses, merkle, neardup, oracles, quality, repeats, secrets, sharding, tokenfiles, toxicity, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op4_bpe")
def _bpe(read):
    return bpe.digests(read("documents"), public_tokenizers.path(VOCABULARY))


@query("op8_quality_rules")
def _quality(read):
    return quality.judge(read("documents"))


@query("op6_near_duplicates")
def _near_duplicates(read):
    return neardup.near_duplicates(read("documents"))


@query("op2_secrets", oracles.secrets())
def _secrets(read):
    return secrets.digests(read("documents"))


@query("op3_licenses", oracles.licenses())
def _licenses(read):
    return licenses.scan(read("documents"))


@query("op7_decontamination", oracles.decontamination())
def _decontamination(read):
    return decontaminate.decontaminate(read("documents"), read("benchmark"))


@query("op1_html_text")
def _html(read):
    return wrappers.extract(read("pages"))


@query("op5_toxicity")
def _toxicity(read):
    return toxicity.score(read("documents"), read("labels"))


@query("op9_repeated_passages")
def _repeats(read):
    return repeats.passages(read("documents"))


@query("op10_sharding")
def _sharding(read):
    return sharding.shard(read("documents"))


@query("op11_source_divergence", oracles.divergence())
def _divergence(read):
    return divergence.audit(read("documents"))


@query("op12_merkle_manifest", oracles.merkle())
def _merkle(read):
    docs = read("documents")
    return merkle.manifest(docs, other=merkle.tampered_leaf(docs))


@query("op13_token_files")
def _token_files(read):
    docs = read("documents")
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(docs, public_tokenizers.path(VOCABULARY), folder)
    return tokenfiles.checksums(docs.sparkSession.read.parquet(folder))
