"""Several values packed in one field, separated by inconsistent delimiters, sometimes quoted.

A *dialect* is a separator set plus a protection rule (quotes, backslashes, a JSON array). Every distinct
field is parsed with every dialect that its characters allow. The cheapest parse by description length wins:

    L(parse) = bits(dialect) + sum over values of bits(value) + bits(separators and void elements)

bits(value) is the cheaper of spelling the value with a character-class transition code and of quoting a
dictionary of values, whose entries pay for their own spelling once, shared by all fields that use them.
Both codes are measured over the whole corpus by distributed counts: the transition code over fields on
which all dialects agree (these need no decision), the dictionary over every candidate parse of every distinct field.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.runtime import free_names, materialize, parallelism

# Separators in use, brackets that protect, pairs of quotes, and texts that only say there is no name.
SEPARATORS = (";", ",", "|", "||", "/", "\t", "\n", "、", "，", "；", "·", "•")
SPACED = ("/", "·", "•")  # these separate only between white space
MIXED = (";", ",", "|", "/", "\t", "\n")
QUOTES = ('""', "''", "“”", "«»")
BRACKETS = {"[": "]", "(": ")"}
VOID = frozenset({"", "null", "n/a", "na", "none", "nil", "nan", "-", "--", "–", "—", "?", "[]", "{}", "unknown", "no name", "unnamed"})

#: Stands for a separator that a dialect protects, in the text that is coded (private use area).
PROTECTED = "\ue000"
MARKS = re.compile(r"[;,|/\t\n\"\\]")
BRACKETED = re.compile(r"\[[^\]]*\]|\([^)]*\)")
#: Bits of one choice of dialect, of each further separator kind, of a void element.
DIALECT_BITS, KIND_BITS, BLANK_BITS, SEP_BITS, QUOTE_BITS = 2.0, 3.0, 1.0, 1.0, 1.5
#: Parts into which one use of a word is divided among the candidates of a field.
SHARES = 1 << 30
#: Bits of a protected separator inside a value.
PROTECTED_BITS = 4.0

PARSE = T.StructType([
    T.StructField("dialect", T.StringType()),
    T.StructField("coded", T.ArrayType(T.StringType())),
    T.StructField("bits", T.DoubleType()),
])


def _separator_at(text: str, i: int, seps: tuple[str, ...]) -> int:
    """Length of the separator that begins at i, or 0."""
    for s in seps:
        if text.startswith(s, i):
            if s in SPACED and not ((i == 0 or text[i - 1].isspace()) and (i + len(s) == len(text) or text[i + len(s)].isspace())):
                continue
            if s == "|" and "||" in seps and text.startswith("||", i):
                return 2
            return len(s)
    return 0


@lru_cache(maxsize=4096)
def _splitter(seps: tuple[str, ...]) -> re.Pattern:
    """Bracketed parts, and the separators outside of them."""
    kinds = [rf"(?:^|(?<=\s)){re.escape(s)}(?=\s|$)" if s in SPACED else re.escape(s) for s in sorted(seps, key=len, reverse=True)]
    return re.compile(r"(\[[^\]]*\]|\([^)]*\))" + (f"|(?:{'|'.join(kinds)})" if kinds else ""))


def _split_unquoted(text: str, seps: tuple[str, ...]) -> tuple[list[str], list[str], int, int]:
    parts, at = [], 0
    if seps:
        for m in _splitter(seps).finditer(text):
            if m.group(1) is None:
                parts.append(text[at : m.start()])
                at = m.end()
    parts.append(text[at:])
    names = [v for v in (x.strip() for x in parts) if v.lower() not in VOID]
    return names, [BRACKETED.sub(lambda m: _mark(m.group()), v) if "[" in v or "(" in v else v for v in names], len(parts), 0


def parse_with(text: str, seps: tuple[str, ...], protect: str) -> tuple[list[str], list[str], int, int]:
    """Values of `text` under one dialect, the same as they are coded, elements in all, protected elements.

    protect: '' (brackets only), 'esc' (a backslash protects the next character), 'json' (an array of strings)
    or a pair of quotes, of which a doubled closing one stands for itself.
    """
    if protect == "json":
        try:
            got = json.loads(text)
        except ValueError:
            return [text], [text], 1, 0
        if not isinstance(got, list) or not all(x is None or isinstance(x, str) for x in got):
            return [text], [text], 1, 0
        values = [(x or "").strip() for x in got]
        kept = [v for v in values if v.lower() not in VOID]
        return kept, [_mark(v) for v in kept], len(values), len(values)
    if not protect:
        return _split_unquoted(text, seps)
    names: list[str] = []
    coded: list[str] = []
    elements = guarded = 0
    i, n = 0, len(text)
    name: list[str] = []
    code: list[str] = []
    opened = closing = ""

    def end() -> None:
        nonlocal name, code, elements
        elements += 1
        v = "".join(name).strip()
        if v.lower() not in VOID:
            names.append(v)
            coded.append("".join(code).strip())
        name, code = [], []

    while i < n:
        c = text[i]
        if protect == "esc" and c == "\\" and i + 1 < n:
            guarded += 1
            name.append(text[i + 1])
            code.append(PROTECTED)
            i += 2
            continue
        if len(protect) == 2 and c == protect[0] and not "".join(name).strip():
            close, j, inner = protect[1], i + 1, []
            while j < n:
                if text[j] == close:
                    if text.startswith(close * 2, j) and protect[0] == close and close == '"':
                        inner.append(close)
                        j += 2
                        continue
                    k = j + 1
                    while k < n and text[k].isspace() and not _separator_at(text, k, seps):
                        k += 1
                    if k == n or _separator_at(text, k, seps):
                        break
                inner.append(text[j])
                j += 1
            if j < n:
                guarded += 1
                value = "".join(inner)
                name, code = [value], [_mark(value)]
                i = k
                continue
        if closing:
            if c == closing:
                closing = ""
            name.append(c)
            code.append(c if not _separator_at(text, i, seps) else PROTECTED)
            i += 1
            continue
        if c in BRACKETS and text.find(BRACKETS[c], i) > 0:
            closing = BRACKETS[c]
        width = _separator_at(text, i, seps)
        if width:
            end()
            i += width
            continue
        name.append(c)
        code.append(c)
        i += 1
    end()
    return names, coded, elements, guarded


def _mark(value: str) -> str:
    return MARKS.sub(PROTECTED, value)


def candidate_parses(text: str) -> list[dict]:
    """All different parses of one field, each with the dialect that says it most briefly and the bits of its structure."""
    present = [s for s in SEPARATORS if s in text]
    if "||" in present and text.replace("||", "").count("|") == 0:
        present.remove("|")
    kinds: list[tuple[str, ...]] = [()] + [(s,) for s in present]
    mixed = tuple(s for s in MIXED if s in text)
    if len(mixed) > 1:
        kinds.append(mixed)
    protects = [""] + [q for q in QUOTES if q[0] in text and q[1] in text] + (["esc"] if "\\" in text else [])
    if text[:1] == "[" and text[-1:] == "]":
        protects.append("json")
    best: dict[tuple[str, ...], dict] = {}
    for protect in protects:
        for seps in [()] if protect == "json" else kinds:
            names, coded, elements, guarded = parse_with(text, seps, protect)
            voids = elements - len(names)
            bits = DIALECT_BITS + KIND_BITS * max(0, len(seps) - 1) + SEP_BITS * (elements - 1) + BLANK_BITS * voids + (QUOTE_BITS + DIALECT_BITS if protect else 0.0)
            key = tuple(names)
            if key not in best or bits < best[key]["bits"]:
                best[key] = {"dialect": json.dumps([list(seps), protect]), "names": names, "coded": coded, "bits": bits}
    return list(best.values())


@F.pandas_udf(T.ArrayType(PARSE))
def _candidates(fields: pd.Series) -> pd.Series:
    return fields.map(lambda f: [(p["dialect"], p["coded"], p["bits"]) for p in candidate_parses(f)])


def char_class(c: str) -> str:
    """Letters by script and case, digits, blanks; any other character is its own class."""
    o = ord(c)
    if o < 128:
        return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c
    if c.isspace():
        return " "
    if c.isalpha():
        page = 0 if o < 0x370 or 0xFF00 <= o < 0xFF60 else 1 if o < 0x400 else 2 if o < 0x530 else 3
        return ("A" if c.isupper() else "a") if page == 0 else f"{'U' if c.isupper() else 'l'}{page}"
    return "m" if o >= 0x300 and not c.isalnum() and (o < 0x370 or 0x2000 <= o < 0x2070 or o in (0xFEFF, 0xAD)) else c


def transitions(value: str) -> Iterator[tuple[str, str]]:
    last = "^"
    for c in value:
        k = char_class(c)
        yield last, k
        last = k
    yield last, "$"


class SpellingCode:
    """Bits of a text under a class-transition code with additive smoothing; a letter pays its class and its place in it."""

    INSIDE = {"A": 4.7, "a": 4.0, "0": 3.3, "U1": 4.6, "l1": 4.6, "U2": 5.0, "l2": 5.0, "U3": 8.0, "l3": 8.0, "m": 3.0}

    #: What is known before any count: values are words.
    PRIOR = {("^", "A"): 4, ("^", "a"): 1, ("^", "0"): 1, ("A", "a"): 4, ("A", "A"): 1, ("a", "a"): 16, ("a", " "): 1, (" ", "A"): 1, (" ", "a"): 1, ("a", "$"): 4, ("A", "$"): 1, ("0", "0"): 1, ("0", "$"): 1}

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = {k: counts.get(k, 0) + self.PRIOR.get(k, 0) for k in counts.keys() | self.PRIOR.keys()}
        counts = self.counts
        self.total: dict[str, int] = {}
        for (a, _), n in counts.items():
            self.total[a] = self.total.get(a, 0) + n
        self.memo: dict[tuple[str, str], float] = {}

    def step(self, a: str, b: str) -> float:
        got = self.memo.get((a, b))
        if got is None:
            got = -math.log2((self.counts.get((a, b), 0) + 0.01) / (self.total.get(a, 0) + 1.0)) + self.INSIDE.get(b, 0.0)
            self.memo[a, b] = got
        return got

    def bits(self, value: str) -> float:
        return sum(self.step(a, b) for a, b in transitions(value))


def _count_transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of one partition; bounded by the number of class pairs."""
    seen: dict[tuple[str, str], int] = {}
    for pdf in batches:
        for names in pdf["coded"]:
            for v in names:
                for u in v.split(PROTECTED):
                    for t in transitions(u):
                        seen[t] = seen.get(t, 0) + 1
    yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])


def unpack(df: DataFrame, field: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value packed in column `field`, all other columns kept, with its position (from 1) and text.

    Null and blank fields and void elements (only white space, or a text that says there is no name) give no row
    and take no position; repeated values stay repeated. Very long fields are parsed whole. Repeated rows are parsed
    each like the others. An empty table gives an empty result. Columns of df that are called like `pos` or `value` come
    out with a leading underscore.
    """
    for c in df.columns:
        if c.lower() in (pos.lower(), value.lower()):
            new = free_names(df, "_" + c)[0]
            df, field = df.withColumnRenamed(c, new), new if c == field else field
    f_, p_, n_ = free_names(df, "__field", "__parse", "__n")
    tasks = parallelism(df.sparkSession)  # few bytes cost much Python here, so partitions must not be merged by size
    fields = df.select(F.col(field).alias("f")).where(F.col("f").isNotNull() & (F.trim("f") != "")).groupBy("f").agg(F.lit(1).alias("one")).repartition(tasks, "f")
    # every candidate of a distinct field is parsed once and written as it is coded; values come from one more parse, by the chosen dialect
    found = fields.select(_key(F.col("f")).alias("f"), F.when(F.col("f") != _key(F.col("f")), F.col("f")).alias("text"), _candidates("f").alias("c"))
    parsed = materialize(found, "parses")
    sure = parsed.where(F.size("c") == 1)
    rows = sure.select(F.col("c")[0]["coded"].alias("coded")).mapInPandas(_count_transitions, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    code = df.sparkSession.sparkContext.broadcast({(r.a, r.b): r.n for r in rows})  # classes squared at most, whatever the corpus

    @F.pandas_udf(T.DoubleType())
    def spelled(values: pd.Series) -> pd.Series:
        return values.map(SpellingCode(code.value).bits)

    each = parsed.select("f", F.size("c").alias("of"), F.posexplode("c").alias("cid", "p"))
    # the coded unit is what stands between protected separators, so that a part repeated under protection is as cheap as one repeated without it
    units = F.flatten(F.transform(F.col("p.coded"), lambda v: F.filter(F.split(v, PROTECTED), lambda u: F.trim(u) != "")))
    each = each.select("f", "cid", "of", F.col("p.bits").alias("bits"), units.alias("units"), F.size("p.coded").alias("values"))
    # what belongs to the parse is worked out before its units are told apart, once per parse
    vals = each.select("f", "cid", "of", "bits", (F.size("units") - F.col("values")).alias("inner"), "units").select("f", "cid", "of", "bits", "inner", F.explode_outer("units").alias("unit"))
    # a dictionary entry counts once per parse of a field; equal words are added up before they are shuffled
    words = (
        each.select("of", F.explode(F.array_distinct("units")).alias("word"))
        .groupBy("word").agg(F.greatest(F.lit(1.0), F.sum((F.lit(SHARES) / F.col("of")).cast("long")) / SHARES).alias("uses"))  # whole numbers: the same sum in any order
        .repartition(tasks, "word")
        .withColumn("spell", spelled("word"))
    )
    total = F.lit(math.log2(2 + sum(r.n for r in rows if r.a == "^")))
    words = words.select("word", F.least(F.col("spell"), total - F.log2("uses") + F.col("spell") / F.col("uses") + 1.0).alias("vbits"))
    scored = (
        vals.where(F.col("of") > 1)
        .join(words, F.col("unit") == F.col("word"), "left")
        .groupBy("f", "cid").agg((F.first("bits") + F.coalesce(F.sum("vbits"), F.lit(0.0)) + PROTECTED_BITS * F.greatest(F.first("inner"), F.lit(0))).alias("dl"))
        .groupBy("f").agg(F.min_by("cid", F.struct("dl", "cid")).alias("cid"))
    )
    chosen = parsed.select("f", "text", F.col("c.dialect").alias("d")).join(scored, "f", "left").select("f", F.coalesce("text", "f").alias("text"), F.col("d")[F.coalesce("cid", F.lit(0))].alias("d"))
    named = chosen.repartition(tasks, "f").select(F.col("f").alias(f_), _parsed("text", "d").alias(p_))
    base = df.where(F.col(field).isNotNull() & (F.trim(F.col(field)) != ""))
    return (
        base.join(named, _key(F.col(field)) == F.col(f_))
        .select(*df.columns, F.posexplode(p_).alias(n_, value))
        .withColumn(pos, (F.col(n_) + 1).cast("int"))
        .select(*df.columns, pos, value)
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed(fields: pd.Series, dialect: pd.Series) -> pd.Series:
    """The values of each field by its dialect."""
    read = {d: json.loads(d) for d in dialect.unique()}
    return pd.Series([parse_with(f, tuple(read[d][0]), read[d][1])[0] for f, d in zip(fields, dialect)], dtype=object)


def _key(field: Column) -> Column:
    """Short name of a field: itself, or its SHA-256 if that is shorter, so that no row carries a long field along."""
    return F.when(F.length(field) <= 64, field).otherwise(F.sha2(field.cast("binary"), 256))


def dialects(df: DataFrame, field: str) -> Column:
    """Candidate parses of a field, for inspection."""
    return _candidates(df[field])
