"""Text normalisation, grams and one-edit matching as Column expressions, and the same for query literals.

Everything runs inside the JVM: compatibility normalisation (NFKC) and the script-variant rule both come
from the ICU library on Spark's class path, so there is no Python UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_RUNS = "[a-z0-9]+|[一-鿿㐀-䶿]+"
_DROP = r"[\s\p{Z}\x{FEFF}\p{P}\p{S}]"
#: Fixed value: kept apart from its simplified look-alike, so that the reign name stays itself.
KEPT_VARIANTS = "乾"
#: Variants that are read otherwise than the library's rule has them, or not by it at all.
OTHER_VARIANTS = "嶽岳 鑪炉 鶏鸡 鴎鸥 韈袜 龎庞 儗拟 鎌镰 閙闹 鶓鹇 鼕咚 齗龃 鎪镂 逕径 韆千 鷦鹩"
_tables: dict[int, tuple[str, str]] = {}


def variant_table(spark: SparkSession, rule: str = "Traditional-Simplified") -> tuple[str, str]:
    """(from, to): single characters that the ICU rule maps to another single character."""
    known = _tables.get(id(spark))
    if known is None:
        chars = [chr(c) for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000)) for c in range(lo, hi)]
        mapped = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate(" ".join(chars)).split(" ")
        pairs = {a: b for a, b in zip(chars, mapped, strict=True) if a != b and len(b) == 1 and a not in KEPT_VARIANTS}
        pairs |= {p[0]: p[1] for p in OTHER_VARIANTS.split()}
        known = _tables[id(spark)] = ("".join(pairs), "".join(pairs.values()))
    return known


def nfkc(c: Column) -> Column:
    """Compatibility composition; ASCII is left as it is."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def t2s(spark: SparkSession, c: Column) -> Column:
    return F.translate(c, *variant_table(spark))


def norm(spark: SparkSession, c: Column) -> Column:
    """NFKC, traditional to simplified, lower case, without space, punctuation and symbols; null is ''."""
    return F.regexp_replace(F.lower(t2s(spark, nfkc(F.coalesce(c, F.lit(""))))), _DROP, "")


def norm_text(spark: SparkSession, s: str | None) -> str:
    """norm of a query literal, on the driver."""
    s = unicodedata.normalize("NFKC", s or "").translate(_mapping(*variant_table(spark))).lower()
    return "".join(c for c in s if not (c.isspace() or c == "﻿" or unicodedata.category(c)[0] in "PSZ"))


@lru_cache(4)
def _mapping(a: str, b: str) -> dict[int, int]:
    return {ord(x): ord(y) for x, y in zip(a, b, strict=True)}


def cjk_grams(run: Column) -> Column:
    n = F.length(run)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, 2))
    return F.when(n == 1, F.array(run)).otherwise(F.concat(pairs, F.split(run, "")))


def tokens(normalised: Column) -> Column:
    """Distinct grams: latin and digit runs whole; CJK runs as bigrams and single characters."""
    runs = F.regexp_extract_all(normalised, F.lit(_RUNS), F.lit(0))
    each = F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(cjk_grams(r)))
    return F.array_distinct(F.flatten(each))


def segments(normalised: str) -> dict[str, list[str]]:
    """Runs of a normalised query, in order, duplicates kept."""
    out: dict[str, list[str]] = {"latin": [], "cjk": []}
    last = None
    for ch in normalised:
        kind = "latin" if ch.isascii() and (ch.islower() or ch.isdigit()) else "cjk" if "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿" else None
        if kind and kind == last:
            out[kind][-1] += ch
        elif kind:
            out[kind].append(ch)
        last = kind
    return out


def segment_grams(normalised: str) -> list[list[str]]:
    """For each segment the grams of which one must occur: a latin run itself; bigrams and end characters of CJK."""
    s = segments(normalised)
    out = [[t] for t in s["latin"]]
    for run in s["cjk"]:
        pairs = [run[i : i + 2] for i in range(len(run) - 1)]
        out.append(list(dict.fromkeys([*pairs, run[0], run[-1]])))
    return out


def window(n: Column, q: str) -> Column:
    """The shortest, then leftmost piece of n one edit away from q; null if there is none or q has one character."""
    if len(q) < 2:
        return F.lit(None).cast("string")
    lit = F.lit(q)

    def pieces(size: int) -> Column:
        return F.when(
            F.length(n) >= size, F.transform(F.sequence(F.lit(1), F.length(n) - size + 1), lambda i: F.substring(n, i, size))
        ).otherwise(F.array().cast("array<string>"))

    near = F.flatten(F.array(*[pieces(size) for size in range(max(2, len(q) - 1), len(q) + 2)]))
    # One edit leaves one half of q as it is.
    half = len(q) // 2
    return F.when(n.contains(q[:half]) | n.contains(q[half:]), F.get(F.filter(near, lambda w: F.levenshtein(w, lit, 1) >= 0), F.lit(0)))


@lru_cache(1 << 16)
def within_one(a: str, b: str) -> bool:
    """Are two strings at most one edit apart?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def instant(c: Column) -> Column:
    """An ISO-8601 string as an instant; null if it does not parse."""
    return c.try_cast("timestamp")
