"""Visually identical text in one form, so that comparisons work.

Canonical form: canonical composition (NFC) after wide, narrow and no-break variants take their plain form,
every blank is the plain space, characters that cannot be seen are gone, and look-alike letters of other scripts,
script variants and hyphens take one form. Case, accents and other punctuation are visible and stay.

Only unstable segments are touched: maximal runs of characters whose quick-check property is not "yes" for this form,
each with its boundary context, i.e. the starter before it, to which marks may compose. Canonical segments are spliced
into the otherwise unchanged text. Text without such a character is returned as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Letters that look the same, by script, with the form that they take.
LOOKALIKES = str.maketrans(
    # Cyrillic capitals, Cyrillic small letters
    "АВЕЅІЈКМНОРСТХҮԌԚԜ" "аеѕіјорсухһԁԛԝӏ"
    # Greek capitals, Greek small letters, Armenian, Latin script variants
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "οϳνρ" "օսոհ" "ɡɑɩ"
    # hyphens
    "‐‑",
    "ABESIJKMHOPCTXYGQW" "aesijopcyxhdqwl"
    "ABEZHIKMNOPTYX" "ojvp" "ounh" "gai"
    "--",
)
# Ligatures of letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
# Ranges of characters that leave no mark (default ignorable).
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))


def _unseen(c: str) -> bool:
    o = ord(c)
    return any(a <= o <= b for a, b in IGNORABLE)


@lru_cache(maxsize=None)
def _plain(c: str) -> str:
    """What one character stands for, before composition."""
    if _unseen(c):
        return ""
    if c in LIGATURES:
        return LIGATURES[c]
    if unicodedata.category(c) == "Zs":
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in ("<wide>", "<narrow>", "<noBreak>"):
        return "".join(_plain(chr(int(x, 16))) for x in rest.split())
    return "".join(x.translate(LOOKALIKES) for x in unicodedata.normalize("NFD", c))


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """Runs of characters for which the quick check does not say yes, with the character before each run."""
    second = set()  # characters that may compose with the one before them
    hit = []
    # the blocks left out hold unified ideographs, composed Hangul, surrogates and unassigned planes, all stable
    for o in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)):
        c = chr(o)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<"):
            second.update(chr(int(x, 16)) for x in d.split()[1:])
        if unicodedata.combining(c) or o in LOOKALIKES or _unseen(c) or d and unicodedata.normalize("NFC", _plain(c)) != c or c in LIGATURES or unicodedata.category(c) == "Zs":
            hit.append(o)
    hit = sorted({*hit, *(ord(c) for c in second if ord(c) >= 0x80), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})
    spans, start = [], None
    for a, b in zip(hit, [*hit[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            spans.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return re.compile(f"(?s).?[{''.join(spans)}]+")


def canonical(text: str) -> str:
    """The canonical form of one text."""
    if text.isascii():
        return text
    return _unstable().sub(lambda m: unicodedata.normalize("NFC", "".join(map(_plain, m.group()))), text)


def canonical_whole(text: str) -> str:
    """The same by normalising the whole text; for tests."""
    return unicodedata.normalize("NFC", "".join(map(_plain, text)))


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """Canonical form of a column; null stays null and '' stays ''. ASCII text comes back as it is, at the cost of a look.

    The form is a key for comparison: letters that look Latin become Latin, so words of other scripts come out mixed.
    """
    return _canonical_udf(text)


def alike_classes(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """(group columns, form, spellings, rows) of the classes of texts that look the same in a group but differ; one row a class, however large.

    Null and empty texts are in no class. Equal rows are counted before they meet.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(*group, F.col(text).alias("__v")).agg(F.count("*").alias("__n"))
    forms = rows.withColumn("form", canonical_text(F.col("__v")))
    return forms.groupBy(*group, "form").agg(F.count("*").alias("spellings"), F.sum("__n").alias("rows")).where(F.col("spellings") > 1)


def alike_pairs(df: DataFrame, key: str, group: list[str], text: str) -> DataFrame:
    """Pairs key_a < key_b of rows of one group whose texts look the same but are different strings.

    Null and empty texts, null keys and null groups form no pairs; each pair stands once. Rows of one string are never
    compared with each other: classes of look-alike strings with a single spelling are dropped before any pair is made.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(key).alias("k"), F.col(text).alias("v"))
    by = [f"g{i}" for i in range(len(group))]
    # distinct spellings only go through Python; nearly all texts have few distinct values
    forms = rows.select("v").distinct().withColumn("form", canonical_text(F.col("v")))
    known = rows.join(forms, "v")
    several = known.groupBy(*by, "form").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("lo") != F.col("hi")).select(*by, "form")
    live = known.join(several, [*by, "form"], "left_semi").distinct()
    a = live.select(*by, "form", F.col("k").alias("key_a"), F.col("v").alias("va"))
    b = live.select(*by, "form", F.col("k").alias("key_b"), F.col("v").alias("vb"))
    return a.join(b, [*by, "form"]).where((F.col("key_a") < F.col("key_b")) & (F.col("va") != F.col("vb"))).select("key_a", "key_b").distinct()
