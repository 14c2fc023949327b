"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import canonical, digest, linking, mixing, stuffing, tokens
from gridloom.runtime import BROADCAST_ROWS, load, materialize

MEASURES = ["segment_length_median", "edge_circuity_mean"]


def _metric_rows(spark: SparkSession, root: str, *keys: str) -> DataFrame:
    """Rows of the metric table without re-deliveries, which differ in loaded_at only."""
    identity = ["unit_id", "network_type", "scale", "run_id"]
    rows = load(spark, root, "local_morphology_metrics").select(*identity, "city_id", *MEASURES)
    return rows.groupBy(*rows.columns).agg(F.lit(1).alias("one")).select(*keys, *MEASURES)


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Per city and scale, from the digests of all partitions."""
    keys = ["city_id", "scale"]
    return digest.percentiles(digest.digests(_metric_rows(spark, root, *keys), keys, MEASURES), keys)


def p2_by_run(spark: SparkSession, root: str) -> DataFrame:
    """Per city, scale and run."""
    keys = ["city_id", "scale", "run_id"]
    return digest.percentiles(digest.digests(_metric_rows(spark, root, *keys), keys, MEASURES), keys)


def p2_combined(spark: SparkSession, root: str) -> DataFrame:
    """Per city and scale, from stored digests of single runs."""
    keys = ["city_id", "scale"]
    runs = materialize(digest.merge(digest.digests(_metric_rows(spark, root, *keys, "run_id"), [*keys, "run_id"], MEASURES), [*keys, "run_id"]), "runs")
    return digest.percentiles(digest.merge(runs, keys), keys)


def p2_within_bound(spark: SparkSession, root: str) -> DataFrame:
    """Per city, scale and measure: the exact number of values, and whether every percentile of the digest keeps its bound.

    within_bound compares n and, for each percentile, the ranks that values on the percentile's place of the universe have.
    """
    keys = ["city_id", "scale"]
    rows = _metric_rows(spark, root, *keys)
    got = materialize(digest.percentiles(digest.digests(rows, keys, MEASURES), keys), "percentiles")
    names = [c for c in got.columns if c not in (*keys, "metric", "n", "rank_error")]
    said = got.select(*[F.col(c).alias(f"__{c}") for c in keys], "metric", F.col("n").alias("digest_n"), "rank_error", *names)
    values = rows.unpivot(keys, MEASURES, "measure", "x").where(F.abs("x") < float("inf"))
    here = values.join(F.broadcast(said) if said.count() <= BROADCAST_ROWS else said, F.col("measure").eqNullSafe(F.col("metric")) & F.col("city_id").eqNullSafe(F.col("__city_id")) & F.col("scale").eqNullSafe(F.col("__scale")))
    ranks = [F.count_if(F.col("x") < F.col(c) - F.abs(c) * 1e-6).alias(f"below_{c}") for c in names] + [F.count_if(F.col("x") <= F.col(c) + F.abs(c) * 1e-6).alias(f"upto_{c}") for c in names]
    counted = here.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.first("digest_n").alias("digest_n"), F.first("rank_error").alias("e"), *ranks)
    ok = F.col("n") == F.col("digest_n")
    for p, c in zip(digest.PROBS, names):
        want = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9))
        ok &= (F.col(f"below_{c}") < want + F.col("e")) & (F.col(f"upto_{c}") >= want - F.col("e"))
    return counted.select(*keys, "metric", "n", ok.alias("within_bound"))


P2_WITHIN_SQL = """
WITH r AS (SELECT DISTINCT unit_id, network_type, scale, run_id, city_id, segment_length_median, edge_circuity_mean FROM local_morphology_metrics),
v AS (SELECT city_id, scale, 'segment_length_median' AS metric, segment_length_median AS x FROM r UNION ALL SELECT city_id, scale, 'edge_circuity_mean', edge_circuity_mean FROM r)
SELECT city_id, scale, metric, count(*) AS n, true AS within_bound FROM v WHERE isfinite(x) GROUP BY city_id, scale, metric
"""


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    cities = load(spark, root, "ghs_ucdb")
    codes = load(spark, root, "candidate_city").select(F.col("iso3").alias("alias"), "country").distinct()
    official = cities.select(F.col("gc_cnt_unn_2025").alias("alias"), F.col("gc_cnt_gad_2025").alias("country")).where(F.col("alias").isNotNull()).distinct()
    return linking.link_places(
        load(spark, root, "city_master"), "entry_id", "city_name_en", "country", "iso3",
        cities, "id_uc_g0", "gc_ucn_mai_2025", "gc_cnt_gad_2025", codes.unionByName(official),
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    typed = canonical.alike_pairs(load(spark, root, "city_master"), "entry_id", ["batch_id"], "city_name_en")
    packed = canonical.alike_pairs(load(spark, root, "ghs_ucdb_raw"), "raw_id", ["delivery_id", "id_uc_g0"], "gc_ucn_lis_2025")
    return typed.select(F.lit("city_master").alias("src"), "key_a", "key_b").unionByName(packed.select(F.lit("ghs_ucdb_raw").alias("src"), "key_a", "key_b"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    return docs.select("doc_id", tokens.encode(spark, F.col("text")).alias("ids"))


def p7_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Digest of each text after encoding and streaming decoding."""
    docs = load(spark, root, "documents").select("doc_id", tokens.encode(spark, F.col("text")).alias("ids"))
    text = docs.select("doc_id", tokens.decode(spark, F.col("ids")).alias("t"))
    return text.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("chars"))


P7_ROUNDTRIP_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents"


def _sized(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", "source", "text")
    return mixing.sized(docs.select("doc_id", "source", tokens.count(spark, F.col("text")).alias("n_tokens")), F.col("n_tokens"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(_sized(spark, root), load(spark, root, "source_weight")).select("doc_id", "source", "n_tokens", "copy_no")


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.report(_sized(spark, root), load(spark, root, "source_weight"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", "text")
    return stuffing.stuffed(docs, load(spark, root, "doc_review"), "doc_id", "text", "is_stuffed").select("doc_id")


QUERIES = {"p2_percentiles": p2_percentiles, "p2_by_run": p2_by_run, "p2_combined": p2_combined, "p2_within_bound": p2_within_bound, "p3_found": p3_found, "p6_found": p6_found, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found}
SQL = {"p2_within_bound": P2_WITHIN_SQL, "p7_roundtrip": P7_ROUNDTRIP_SQL}
