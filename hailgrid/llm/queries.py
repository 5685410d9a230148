"""The corpus queries: each applies its operator, with production settings, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hailgrid.llm import bpe, centroids, collocations, credentials, graph_ann, impact, kdtree, langid, licenses, oracles, packing, partenum, pivots, warc
from hailgrid.llm.common import bounded_batches, table
from hailgrid.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard(table(spark, sf_dir, "documents"), shards=24)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"), query_every=100, k=10)


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return warc.round_trip(table(spark, sf_dir, "pages"), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return partenum.link(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_ns_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.nearest(table(spark, sf_dir, "embeddings"), query_every=50)


def queries() -> dict[str, Query]:
    return {
        "op1_credential_linking": op1_credential_linking,
        "op2_cost_packing": op2_cost_packing,
        "op3_kd_sharding": op3_kd_sharding,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_pruned_graph_ann": op5_pruned_graph_ann,
        "op6_warc_chain": op6_warc_chain,
        "op7_license_containment": op7_license_containment,
        "op8_string_kernel_langid": op8_string_kernel_langid,
        "op9_partenum_jaccard": op9_partenum_jaccard,
        "op10_pivot_permutation": op10_pivot_permutation,
        "op11_trie_collocations": op11_trie_collocations,
        "op12_ns_centroids": op12_ns_centroids,
        "op13_impact_topk": op13_impact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
