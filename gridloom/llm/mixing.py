"""Mixing sources to target weights.

Sizes are token counts. With tok(s) tokens in source s, a mix of T tokens in all repeats the documents of s at the rate
r(s) = share(s) * T / tok(s). Each document comes out floor(r) times, and once more with probability r - floor(r), drawn
by a hash of seed and document id, so the draw is the same in any order and on any cluster.

If T is not asked for, it is the largest total at which every source that has tokens holds its target share exactly
(relative to the shares of sources that have any) without any document being repeated more than max_repeats times. For a
larger T the sources at their cap fall short, and the others fill up in proportion to their shares as far as caps allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.runtime import BROADCAST_ROWS, free_names, materialize

SEED = 20_240_601


def plan(sizes: list[tuple[str, int, float, int]], total: float | None = None) -> dict[str, float]:
    """Repetition rate per source from (source, tokens, target share, max repeats); sources without tokens or share get 0."""
    live = [(s, t, w, m) for s, t, w, m in sizes if t and t > 0 and w and w > 0 and m and m > 0]
    rates = {s: 0.0 for s, *_ in sizes}
    if not live:
        return rates
    if total is None:
        shares = sum(w for _, _, w, _ in live)
        total = min(m * t * shares / w for _, t, w, m in live)
    left, open_ = float(total), live
    while open_:
        shares = sum(w for _, _, w, _ in open_)
        full = [x for x in open_ if left * x[2] / shares >= x[3] * x[1] * (1 - 1e-12)]
        if not full:
            for s, t, w, _ in open_:
                rates[s] = left * w / shares / t
            break
        for s, t, _, m in full:
            rates[s] = float(m)
            left -= m * t
        left = max(0.0, left)
        done = {x[0] for x in full}
        open_ = [x for x in open_ if x[0] not in done]
    return rates


def with_copies(docs: DataFrame, weights: DataFrame, source: str, doc_id: str, tokens: str, copies: str, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(docs of listed sources with the number of their copies, table of rates per listed source).

    `weights` has source, target_share, max_repeats, one row per source; a listed source counts once (the first by share).
    Documents of null or unlisted sources stay out. Null ids draw like one id. `docs` is read twice: materialize it first if it is dear.
    """
    listed = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # few rows per source before the shuffle, thanks to map-side combination, however large one source is
    have = docs.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"))
    rows = listed.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} sources are listed")
    rate = plan([(r.source, r.tokens, r.target_share, r.max_repeats) for r in rows], total)
    table = docs.sparkSession.createDataFrame(
        [(r.source, r.target_share, r.max_repeats, r.documents, r.tokens, rate[r.source]) for r in rows],
        "source string, target_share double, max_repeats int, documents long, source_tokens long, rate double",
    )
    s_, r_ = free_names(docs, "__source", "__rate")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = docs.join(F.broadcast(table.select(F.col("source").alias(s_), F.col("rate").alias(r_))), docs[source] == F.col(s_))
    whole = F.floor(r_)
    return drawn.withColumn(copies, (whole + (chance < F.col(r_) - whole).cast("long")).cast("int")).drop(s_, r_), table


def mix(docs: DataFrame, weights: DataFrame, source: str = "source", doc_id: str = "doc_id", tokens: str = "n_tokens", total: float | None = None, seed: int = SEED) -> DataFrame:
    """The mix: the columns of docs and copy_no (from 1), one row per copy."""
    out, _ = with_copies(docs, weights, source, doc_id, tokens, "__copies", total, seed)
    return out.where(F.col("__copies") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def report(docs: DataFrame, weights: DataFrame, source: str = "source", doc_id: str = "doc_id", tokens: str = "n_tokens", total: float | None = None, seed: int = SEED) -> DataFrame:
    """Per listed source: documents, source_tokens, rate, copies, least and most repeats of a document, mix_tokens, share of the mix, target share."""
    out, table = with_copies(docs, weights, source, doc_id, tokens, "__copies", total, seed)
    got = out.groupBy(F.col(source).alias("source")).agg(F.sum("__copies").alias("copies"), F.min("__copies").alias("fewest"), F.max("__copies").alias("most"), F.sum(F.col("__copies") * F.col(tokens)).alias("mix_tokens"))
    rows = table.join(got, "source", "left").fillna(0, ["copies", "fewest", "most", "mix_tokens"])
    every = rows.agg(F.sum("mix_tokens").alias("__all"))  # one row
    return rows.crossJoin(F.broadcast(every)).withColumn("share", F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("__all")), F.lit(0.0))).drop("__all")


def sized(docs: DataFrame, size, name: str = "n_tokens") -> DataFrame:
    """docs with their sizes, written once, since rates and copies both need them."""
    return materialize(docs.withColumn(name, size), "sizes")
