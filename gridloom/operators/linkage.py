"""Record linkage of a candidate list with a reference list inside blocks: exact id, exact name, alias, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.text import clean_text, similarity_score, token_sort_key


def match_in_blocks(candidates: DataFrame, reference: DataFrame, cand_id: str, cand_name: str, cand_block: str, ref_id: str, ref_name: str, ref_block: str, size: str, least: float = 90.0, shown: int = 5, doubtful: float = 80.0) -> DataFrame:
    """Best reference entry per candidate: method (exact, tokens, fuzzy, low_confidence, unmatched), score, alternatives; ties go to the larger `size`.

    Every pair of names of one block is scored: an equi-join on the block, for reference lists of bounded length. Scores from
    `doubtful` to `least` give the entry as low_confidence.
    """
    def keyed(df: DataFrame, i: str, n: str, b: str) -> DataFrame:
        name = clean_text(F.col(n))
        return df.withColumn("__n", name).withColumn("__t", token_sort_key(name)).withColumn("__b", clean_text(F.col(b))).where(F.col("__n") != "")

    c = keyed(candidates, cand_id, cand_name, cand_block).select(F.col(cand_id).alias("c"), F.col("__n").alias("cn"), F.col("__t").alias("ct"), F.col("__b").alias("b"))
    r = keyed(reference, ref_id, ref_name, ref_block).select(F.col(ref_id).alias("r"), F.col("__n").alias("rn"), F.col("__t").alias("rt"), F.col("__b").alias("b"), F.col(size).alias("size"))
    pairs = c.join(r, "b")
    s = similarity_score()
    scored = pairs.withColumn("score", F.when(F.col("cn") == F.col("rn"), F.lit(100.0)).otherwise(s("cn", "rn")))
    method = F.when(F.col("cn") == F.col("rn"), "exact").when(F.col("ct") == F.col("rt"), "tokens").when(F.col("score") >= least, "fuzzy").when(F.col("score") >= doubtful, "low_confidence")
    scored = scored.withColumn("method", method).withColumn("tier", F.when(F.col("method") == "exact", 0).when(F.col("method") == "tokens", 1).when(F.col("method") == "fuzzy", 2).when(F.col("method") == "low_confidence", 3).otherwise(4))
    w = Window.partitionBy("c").orderBy("tier", F.desc("score"), F.desc_nulls_last("size"), "r")
    top = scored.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= shown)
    label = F.concat(F.col("rn"), F.lit(" ("), F.format_number("score", 1), F.lit(")"))
    best = top.groupBy("c").agg(
        F.min(F.when((F.col("rn_") == 1) & (F.col("tier") < 4), F.col("r"))).alias("r"), F.min(F.when((F.col("rn_") == 1) & (F.col("tier") < 4), F.col("method"))).alias("method"),
        F.min(F.when(F.col("rn_") == 1, F.col("score"))).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn_", label.alias("l")))), lambda x: x["l"]), "; ").alias("alternatives"),
    )
    out = candidates.select(F.col(cand_id).alias("c")).join(best, "c", "left")
    return out.select(F.col("c").alias(cand_id), F.col("r").alias(ref_id), F.coalesce("method", F.lit("unmatched")).alias("method"), "score", F.coalesce("alternatives", F.lit("")).alias("alternatives"))


def exact_id_first(candidates: DataFrame, by_id: DataFrame, by_name: DataFrame, key: str, ref_id: str) -> DataFrame:
    """Identifier match where there is one, else the match by name."""
    a = by_id.select(key, F.col(ref_id).alias("__a"))
    b = by_name.select(key, F.col(ref_id).alias("__b"))
    return candidates.join(a, key, "left").join(b, key, "left").withColumn(ref_id, F.coalesce("__a", "__b")).drop("__a", "__b")
