"""Mapping freely typed values to the closest entry of a reference list; values without one come out unmatched.

Values are deduplicated and normalised; candidates come from an inverted index of the list's character n-grams and are scored
by the cosine of their n-gram weights. Weights are inverse frequencies among the typed values and the list together, so what
many values have in common (titles, kinds of place) weighs little without any list of such words.

A value is accepted if the cosine of its best entry reaches a threshold and leads the next entry by a margin. The thresholds
come from the list itself: each spelling is asked against the entries other than its own. As much as half of the list
resembles another entry is too little; more than all but a hundredth do is enough; between the two the entry is checked:
a third of the letters may differ.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.llm.canonical import canonical
from gridloom.operators.skew import fragment_replicate_join
from gridloom.runtime import materialize, parallelism

# Spellings of letters where marks can't be typed.
DIGRAPHS = {"ä": "ae", "ö": "oe", "ø": "oe", "ü": "ue", "å": "aa", "æ": "ae", "œ": "oe", "ß": "ss", "š": "sh", "č": "ch", "ž": "zh", "ñ": "ny", "ð": "dh", "þ": "th"}
SINGLE = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d"}

MARGIN = 0.02
#: Shares of the list whose nearest other entry is less similar than the lower and the upper threshold; both thresholds of a list of one entry.
LOWER, UPPER, ALONE = 0.5, 0.99, 0.4
#: Cosine below which other entries of the list are not looked for; places of the table of frequencies; spellings and values a task holds.
LEAST, BUCKETS, PART, SHARD = 0.1, 1 << 18, 20_000, 20_000


def _fold(text: str, letters: dict[str, str]) -> str:
    text = unicodedata.normalize("NFC", canonical(text).casefold())
    text = unicodedata.normalize("NFD", "".join(letters.get(c, c) for c in text))
    return " ".join(re.sub(r"[^\w]+|_", " ", "".join(c for c in text if not unicodedata.combining(c))).split())


def parts_of(text: str | None) -> tuple[str, str, str]:
    """Of a typed name: all of it, what stands before brackets or a comma, what stands in or behind them, each normalised."""
    if not text:
        return "", "", ""
    plain = canonical(text)
    m = re.fullmatch(r"\s*(.*?)\s*[(\[]([^()\[\]]*)[)\]]\s*", plain) or re.fullmatch(r"\s*([^,]*?)\s*,\s*(.*?)\s*", plain)
    whole = _fold(text, SINGLE)
    return (whole, _fold(m[1], SINGLE), abbreviation(_fold(m[2], SINGLE))) if m else (whole, whole, "")


def abbreviation(text: str) -> str:
    """Single letters, as they stand between points, come together."""
    return text.replace(" ", "") if re.fullmatch(r"(\w )+\w", text) else text


def variants(text: str) -> list[str]:
    """Spellings under which an entry is indexed: marks dropped, and written as digraphs."""
    return sorted({_fold(text, SINGLE), _fold(text, DIGRAPHS)} - {""})


def grams(text: str) -> list[str]:
    """Letters, pairs, triples and pairs around a letter of each word, with its ends marked; so the order of words is free."""
    out: list[str] = []
    for w in text.split():
        p = f"^{w}$"
        out += w
        out += [p[i : i + 2] for i in range(len(p) - 1)]
        out += [p[i : i + 3] for i in range(len(p) - 2)]
        out += [f"{p[i]}_{p[i + 2]}" for i in range(len(p) - 2)]
    return out


class Index:
    """Inverted index of the spellings of a list, by block and n-gram."""

    def __init__(self, ids: list, spellings: list[str], blocks: list[str | None], frequency: np.ndarray, texts: int):
        self.ids, self.spellings, self.blocks = ids, spellings, blocks
        self.frequency, self.texts = frequency, texts
        self.weight: dict[str, float] = {}
        self.vectors = [self.vector(w) for w in spellings]
        self.posts: dict[tuple[str | None, str], list[int]] = {}
        self.everywhere: dict[str, list[int]] | None = None
        for j, (b, v) in enumerate(zip(blocks, self.vectors)):
            for g in v:
                self.posts.setdefault((b, g), []).append(j)

    def vector(self, text: str) -> dict[str, float]:
        """Weights of the n-grams of a text, of length 1; a gram weighs the logarithm of its rarity, by the root of its count."""
        out = {}
        for g, k in Counter(grams(text)).items():
            w = self.weight.get(g)
            if w is None:
                w = self.weight[g] = math.log((self.texts + 1) / (self.frequency[zlib.crc32(g.encode()) % BUCKETS] + 0.5))
            out[g] = max(w, 0.0) * math.sqrt(k)
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {g: x / norm for g, x in out.items()} if norm else {}

    def best(self, text: str, block: str | None, floor: float, other: object = None) -> list[tuple[float, object, str]]:
        """The two best entries with cosine of at least `floor`, as (cosine, id, spelling); block null: of all blocks; never the entry `other`.

        Only the heaviest n-grams are looked up, as many as leave less than `floor` of the text's length to the rest: an entry
        that shares none of them cannot reach `floor`. So frequent n-grams are rarely met, and nothing is lost.
        """
        mine = self.vector(text)
        if block is None and self.everywhere is None:
            self.everywhere = {}
            for (_, g), js in self.posts.items():
                self.everywhere.setdefault(g, []).extend(js)
        met: set[int] = set()
        rest = 1.0
        for g, x in sorted(mine.items(), key=lambda t: -t[1]):
            if rest < floor * floor - 1e-9:
                break
            met.update(self.everywhere.get(g, ()) if block is None else self.posts.get((block, g), ()))
            rest -= x * x
        found: dict[object, tuple[float, object, str]] = {}
        for j in met:
            if (i := self.ids[j]) == other:
                continue
            theirs = self.vectors[j]
            score = sum(x * theirs[g] for g, x in mine.items() if g in theirs)
            if score >= floor and (i not in found or score > found[i][0]):
                found[i] = (score, i, self.spellings[j])
        return sorted(found.values(), key=lambda t: (-t[0], t[1]))[:2]


_indexes: dict[tuple[str, int], Index] = {}


def _index(token: tuple[str, int], make) -> Index:
    """One index a worker process, used for all groups that need it."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = make()
    return _indexes[token]


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("whole", "name", "added")]))
def _parts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parts_of(t) for t in texts], columns=["whole", "name", "added"])


@F.pandas_udf(T.StringType())
def _country(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: abbreviation(_fold(t, SINGLE)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _variants(texts: pd.Series) -> pd.Series:
    return texts.map(variants, na_action="ignore")


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the distinct texts (column t) each place of the table occurs, and how many texts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, place, n = np.zeros(BUCKETS + 1, dtype=np.int64), {}, 0
        for pdf in batches:
            for t in pdf["t"]:
                n += 1
                for g in set(grams(t)):
                    if (p := place.get(g)) is None:
                        p = place[g] = zlib.crc32(g.encode()) % BUCKETS
                    counts[p] += 1
        counts[BUCKETS] = n
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"p": at, "n": counts[at]})

    got = texts.mapInPandas(run, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[got["p"]] = got["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def _asked(asked: DataFrame, entries: DataFrame, stats: Broadcast, floor: float) -> DataFrame:
    """(v, b, other, r): for each row (v, b, other) its two best entries, r an array of (minus, id, w).

    Values are dealt to tasks, at most SHARD to each, with a copy of the list; a list of more than PART spellings is cut, each
    part meets all values, and the two best of all parts are kept.
    """
    tasks = parallelism(asked.sparkSession)
    parts = max(1, math.ceil(entries.count() / PART))
    shards = max(4 * tasks, math.ceil(asked.count() / SHARD))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("part", each(parts)).withColumn("shard", F.pmod(F.xxhash64("v", "b"), F.lit(shards))).repartition(tasks, "part", "shard")
    right = entries.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts))).withColumn("shard", each(shards)).repartition(tasks, "part", "shard")  # few bytes cost much Python here, so tasks must not be merged by size
    kind = entries.schema["id"].dataType.simpleString()
    token = uuid.uuid4().hex

    def score(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(mine) and len(theirs):
            plain = lambda s: s.astype(object).where(s.notna(), None).tolist()
            index = _index((token, key[0]), lambda: Index(theirs["id"].tolist(), theirs["w"].tolist(), plain(theirs["eb"]), *stats.value))
            for v, b, other in zip(mine["v"], plain(mine["b"]), plain(mine["other"])):
                rows += [(v, b, other, -c, i, w) for c, i, w in index.best(v, b, floor, other)]
        return pd.DataFrame(rows, columns=["v", "b", "other", "minus", "id", "w"])

    schema = f"v string, b string, other {kind}, minus double, id {kind}, w string"
    found = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInPandas(score, schema)
    one = found.groupBy("v", "b", "other", "id").agg(F.min(F.struct("minus", "w")).alias("s"))
    # at most two entries of each part come together
    return one.groupBy("v", "b", "other").agg(F.slice(F.array_sort(F.collect_list(F.struct("s.minus", "id", "s.w"))), 1, 2).alias("r"))


def closest(values: DataFrame, entries: DataFrame, margin: float = MARGIN) -> DataFrame:
    """For each distinct (v, b) of `values` its entry: columns v, b, id, cosine; values without one are missing.

    values: v the normalised text, b the block it must lie in, null for any. entries: id, w a normalised spelling, b its
    block; an entry may have several spellings. Two entries within the margin of cosine are no match.
    """
    spark = values.sparkSession
    entries = materialize(entries.where(F.col("id").isNotNull() & F.col("w").isNotNull() & (F.col("w") != "")).select("id", "w", F.col("b").alias("eb")).distinct(), "entries")
    asked = materialize(values.select("v", "b").where(F.col("v").isNotNull() & (F.col("v") != "")).distinct(), "asked")
    texts = asked.select(F.col("v").alias("t")).distinct().unionAll(entries.select(F.col("w").alias("t")).distinct())
    stats = spark.sparkContext.broadcast(_frequencies(texts))  # BUCKETS numbers
    own = _asked(entries.select(F.col("w").alias("v"), F.col("eb").alias("b"), F.col("id").alias("other")), entries, stats, LEAST)
    near = entries.join(own.select(F.col("v").alias("ow"), F.col("b").alias("ob"), "other", (-F.col("r")[0]["minus"]).alias("c")), (F.col("w") == F.col("ow")) & F.col("eb").eqNullSafe(F.col("ob")) & (F.col("id") == F.col("other")), "left")
    low, high = near.agg(F.percentile_approx(F.coalesce("c", F.lit(0.0)), [LOWER, UPPER], 10_000).alias("q"), F.count_distinct("id").alias("n")).select(F.when(F.col("n") > 1, F.col("q"))).first()[0] or (ALONE, ALONE)
    low = max(low, LEAST + margin)
    found = _asked(asked.withColumn("other", F.lit(None).cast(entries.schema["id"].dataType)), entries, stats, low - margin)
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    sure = (-first["minus"] >= high) | (F.levenshtein("v", first["w"]) * 3 <= F.greatest(F.length("v"), F.length(first["w"])))
    clear = second.isNull() | (second["minus"] - first["minus"] >= margin)
    return found.where((-first["minus"] >= low) & clear & sure).select("v", "b", first["id"].alias("id"), (-first["minus"]).alias("cosine"))


def link_places(typed: DataFrame, key: str, name: str, country: str, iso: str, entries: DataFrame, entry_id: str, entry_name: str, entry_country: str, aliases: DataFrame) -> DataFrame:
    """(key, entry id or 0) for every row of `typed`, null and blank names included.

    The block of a row is its country as typed, else its code, else what stands behind its name if that is a country; the
    same operator finds it among the countries of the list. aliases: (alias, country) further texts that mean a country,
    such as codes. A row whose country is given but is none of the list's gets no entry. Repeated rows come out each; null keys stay.
    """
    whole = F.sha2(F.to_json(F.struct("n", "c", "i")), 256)
    rows = typed.select(F.col(key).alias("key"), F.col(name).alias("n"), F.col(country).alias("c"), F.col(iso).alias("i")).select("key", "n", "c", "i", whole.alias("h"))
    forms = rows.groupBy("h").agg(*[F.first(c).alias(c) for c in ("n", "c", "i")])
    forms = forms.withColumn("p", _parts("n")).select("h", "p.*", _country("c").alias("ck"), _country("i").alias("ik"))
    forms = materialize(forms, "forms")  # read for the countries and for the names
    known = (
        entries.select(F.col(entry_country).alias("country"), F.col(entry_country).alias("alias"))
        .unionByName(aliases.select("country", "alias")).where(F.col("alias").isNotNull() & F.col("country").isNotNull()).distinct()
        .select(F.col("country").alias("id"), _country("alias").alias("w"), F.lit(None).cast("string").alias("b")).distinct()
    )
    spoken = forms.select(F.explode(F.array("ck", "ik", "added")).alias("v"), F.lit(None).cast("string").alias("b"))
    lands = materialize(closest(spoken, known).select(F.col("v").alias("said"), F.col("id").alias("land")), "lands")
    at = lambda c, out: lands.select(F.col("said").alias(c), F.col("land").alias(out))
    forms = forms.join(at("ck", "l1"), "ck", "left").join(at("ik", "l2"), "ik", "left").join(at("added", "l3"), "added", "left")
    given = F.coalesce(F.col("ck") != "", F.lit(False)) | F.coalesce(F.col("ik") != "", F.lit(False))
    block = F.coalesce("l1", "l2", F.when(~given, F.col("l3")))
    forms = materialize(forms.where(~given | block.isNotNull()).select("h", F.when(F.col("l3").isNotNull(), F.col("name")).otherwise(F.col("whole")).alias("v"), block.alias("b")), "blocks")
    index = entries.select(F.col(entry_id).alias("id"), F.explode(_variants(entry_name)).alias("w"), F.col(entry_country).alias("b"))
    found = closest(forms, index).select(F.col("v").alias("fv"), F.col("b").alias("fb"), "id")
    mapped = forms.join(found, (F.col("v") == F.col("fv")) & F.col("b").eqNullSafe(F.col("fb"))).select("h", "id")
    return fragment_replicate_join(rows.select("key", "h"), mapped, "h", "left", spread=["key"]).select(F.col("key").alias(key), F.coalesce("id", F.lit(0)).alias(entry_id))
