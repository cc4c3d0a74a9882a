"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, jaccard_join, licences, mixing, q_url, quality, resampling, token_counts, token_files, topk, toxicity, vector_codes
from .common import read

VOCABULARY = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_spaced_seeds(spark, sf_dir):
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op1_spaced_seeds"] = decontamination.oracle_sql()
QUERIES["op2_url_lists"] = q_url.op2_url_lists
ORACLES["op2_url_lists"] = q_url.SQL


@query
def op3_mix_sources(spark, sf_dir):
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query
def op4_licence_scan(spark, sf_dir):
    return licences.scan(read(spark, sf_dir, "documents")).drop("places")


ORACLES["op4_licence_scan"] = licences.oracle_sql()


@query
def op5_quality_nbsvm(spark, sf_dir):
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.components_and_links(read(spark, sf_dir, "documents"))


@query
def op7_toxic_spans(spark, sf_dir):
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_token_files(spark, sf_dir):
    return token_files.token_digest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op9_topk_search(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


ORACLES["op9_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op11_chat_windows(spark, sf_dir):
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digest(turns, public_tokenizers.path(VOCABULARY))


@query
def op12_target_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op12_target_resampling"] = resampling.oracle_sql()


@query
def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_codes"] = vector_codes.oracle_sql()
