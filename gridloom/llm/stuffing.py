"""Pages made for search engines: repeated keywords, link lists, product tags.

Each text gets shares, all of them computed over the whole text: of its most frequent words, of repeated word pairs, of
repeated lines, of links, of separated tags, and of function words. Words and pairs count inside *runs* only, stretches of phrases
without function words, ends of sentences, numbers mixed with letters and marks of code; so prose and programs have small shares.
A text is stuffed if one share exceeds its threshold. Thresholds are calibrated on a bounded sample of labelled texts, share
by share, pooled and per language of the text (the one whose function words it has most of).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.runtime import free_names

# Words without which there are no sentences, by language.
FUNCTION = {
    "en": frozenset("the a an of to in is it that this and or be are was were as by with from at on not if we you can may so than which when where each its has have must".split()),
    "de": frozenset("der die das ein eine und oder ist sind war wird werden nicht auch als bei von vor zu zum den dem wenn hier kein keine jeder sonst nichts".split()),
    "fr": frozenset("le la les un une et ou est sont a été ne que qui dans sur par pour son sa si se ce sinon rien chaque".split()),
    "es": frozenset("el los las una y o es son ha no que en por para su se si lo del al puede cada nada".split()),
}
EVERY_FUNCTION = frozenset().union(*FUNCTION.values())
#: The shares in the order in which they are calibrated; each is fitted to the labelled texts that those before it leave.
NAMES = ("pairs", "links", "tags", "words", "lines")
#: Threshold of a share without labels: half the text. Labels that calibration may use; labels of either kind that a language needs for its own.
HALF, LABELS, ENOUGH = 0.5, 20_000, 8
#: Words that count as the most frequent, in runs of how many words; times that a pair must stand; words below which shares are reduced.
TOP, LONG, TIMES, FEW = 8, 5, 3, 30

URL = re.compile(r"https?://[^\s\"'<>)\]]+")
ANCHOR = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\(\s*https?://[^)\s]*\)", re.I)
LISTED = re.compile(r"^[^\S\n]*(?:[-*•]|\d+[.)])?[^\S\n]*(?:[^\W_]+[^\S\n]+){0,8}(?:[^\W_]+)?[^\S\n]*(?:->|[-:–|])?[^\S\n]*https?://\S+[^\S\n]*$", re.M)
TAG = re.compile(r"#[^\W_][\w]*")
CODE = re.compile(r"[(){}\[\]=<>$&\\/_@`+^~%]+|[.:](?=\S)|[\"']\s*:|[.!?](?=\s)")  # marks of code, keys of data, ends of sentences: no phrase runs across them
APART = str.maketrans({c: " " for c in map(chr, range(33, 127)) if not c.isalnum()})


def runs_of(text: str) -> tuple[list[list[str]], Counter, int]:
    """Runs of two words or more, function words, number of words. Plain numbers neither count in a run nor end it."""
    runs: list[list[str]] = []
    functions: Counter = Counter()
    total = 0
    for piece in CODE.split(text):
        words = piece.translate(APART).split()
        total += len(words)
        run: list[str] = []
        for w in words:
            if w in EVERY_FUNCTION:
                functions[w] += 1
            elif len(w) > 1 and w.isalpha():
                run.append(w)
                continue
            elif w.isdigit():
                continue
            if len(run) > 1:
                runs.append(run)
            run = []
        if len(run) > 1:
            runs.append(run)
    return runs, functions, total


def is_phrase(line: str) -> bool:
    """The line is one run and nothing else."""
    runs, _, n = runs_of(line)
    return len(runs) == 1 and len(runs[0]) == n


def shares(text: str | None) -> tuple[list[float], float, str]:
    """(the shares of one text in the order of NAMES, its share of function words, its language, '' if it has none)."""
    if not text or text.isspace():
        return [0.0] * len(NAMES), 0.0, ""
    solid = max(1, len(text) - text.count(" ") - text.count("\n"))
    links = 0
    if "://" in text:
        links = sum(len(m) for m in ANCHOR.findall(text)) if "<a" in text or "](" in text or "<A" in text else 0
        links = max(links, sum(len(m) for m in LISTED.findall(text)))
        text = URL.sub(" ", text)
    tags = sum(map(len, TAG.findall(text))) if "#" in text else 0
    text = text.lower()
    lines = Counter(x for x in text.split("\n") if len(x.split(maxsplit=1)) > 1)
    runs, functions, n = runs_of(text)
    counts: Counter = Counter()
    pairs: Counter = Counter()
    for r in runs:
        if len(r) >= LONG:
            counts.update(r)
        pairs.update(zip(r, r[1:]))
    often = {p for p, k in pairs.items() if k >= TIMES}
    repeated = 0
    for r in runs if often else []:
        last = False
        for p in zip(r, r[1:]):
            here = p in often
            repeated += here + (here and not last)
            last = here
    n = max(1, n)
    few = min(1.0, n / FEW)  # shares of a handful of words say little
    by = {lang: sum(c for w, c in functions.items() if w in words) for lang, words in FUNCTION.items()}
    lang = max(by, key=by.__getitem__)
    return [
        few * repeated / n,
        min(1.0, links / solid),
        min(1.0, tags / solid),
        few * sum(sorted(counts.values())[-TOP:]) / n,
        few * sum(k - 1 for x, k in lines.items() if k > 1 and is_phrase(x)) / max(1, lines.total()),
    ], by[lang] / n, lang if by[lang] else ""


SHARES = T.StructType([T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("function", T.DoubleType()), T.StructField("lang", T.StringType())])


@F.pandas_udf(SHARES)
def _shares_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([shares(t) for t in texts], columns=["shares", "function", "lang"])


def page_shares(text: Column) -> Column:
    """Struct of each text's shares in the order of NAMES, its share of function words and its language."""
    return _shares_udf(text)


def threshold(x: np.ndarray, y: np.ndarray) -> float:
    """The cut above which most stuffed texts lie, less twice the others there; of equally good cuts the middle of the widest gap. Infinite if no cut gains."""
    order = np.argsort(-x, kind="stable")
    s, t = x[order], y[order] > 0
    gain = np.cumsum(np.where(t, 1, -2))
    after = np.append(s[1:], 0.0)
    gain = np.where(s > after, gain, -1)  # no cut between equal shares
    if not len(s) or gain.max() <= 0:
        return math.inf
    best = np.flatnonzero(gain == gain.max())
    i = best[np.argmax((s - after)[best])]
    return float((s[i] + after[i]) / 2)


def calibrate(x: np.ndarray, y: np.ndarray, lang: list[str]) -> tuple[list[float], dict[str, list[float]]]:
    """Pooled thresholds of the shares, and those of languages with at least ENOUGH labels of either kind, drawn to the pooled ones.

    A share is fitted to the stuffed texts that no share before it finds. One that finds none then keeps the threshold HALF if
    no labelled other text reaches that, else it is not used. With too few labels every threshold is HALF.
    """
    if (y > 0).sum() < ENOUGH or (y <= 0).sum() < ENOUGH:
        return [HALF] * len(NAMES), {}

    def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
        cuts, left = [], np.ones(len(y), dtype=bool)
        for j in range(x.shape[1]):
            cut = threshold(x[left, j], y[left])
            if math.isinf(cut) and not (x[y <= 0, j] >= HALF).any():
                cut = HALF
            cuts.append(cut)
            left &= ~((x[:, j] > cut) & (y > 0))
        return cuts

    pooled, by, tags = fit(x, y), {}, np.array(lang)
    for v in np.unique(tags):
        here = tags == v
        k = int((y[here] > 0).sum())
        if k >= ENOUGH and (y[here] <= 0).sum() >= ENOUGH:
            own = fit(x[here], y[here])
            by[str(v)] = [p if math.isinf(o) or math.isinf(p) else (o * k + p * ENOUGH) / (k + ENOUGH) for o, p in zip(own, pooled)]
    return pooled, by


def stuffed(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most_labels: int = LABELS) -> DataFrame:
    """Rows of docs judged stuffed, with column `score`: by how much the share that exceeds its threshold most does so.

    labels: (doc_id, label), of which at most `most_labels` with the smallest id hashes are used, undecided ones not.
    Null and blank texts are never stuffed. Repeated rows are judged alike; of texts with one id the first in order is a label's.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most_labels)  # a proven bound of rows, each an id and a flag
    seen = F.broadcast(known).join(docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t")), F.col("__id") == F.col("__d"))
    judged = seen.select("__id", F.struct(page_shares(F.col("__t")).alias("p"), F.col("__y").cast("int").alias("y")).alias("s"))
    rows = judged.groupBy("__id").agg(F.min("s").alias("s")).collect()  # one a label
    x = np.array([r.s.p.shares for r in rows], dtype=float).reshape(len(rows), len(NAMES))
    pooled, by = calibrate(x, np.array([r.s.y for r in rows], dtype=float), [r.s.p.lang for r in rows])
    s_, score = free_names(docs, "__shares", "score")

    def over(j: int) -> Column:
        cut = F.lit(pooled[j])
        for lang, cuts in sorted(by.items()):
            cut = F.when(F.col(s_)["lang"] == lang, cuts[j]).otherwise(cut)
        return F.col(s_)["shares"][j] - cut

    return (
        docs.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
        .withColumn(s_, page_shares(F.col(text))).withColumn(score, F.greatest(*[over(j) for j in range(len(NAMES))])).where(F.col(score) > 0).drop(s_)
    )
