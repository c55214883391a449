r"""Quality rules (operator 1): thresholds with a guaranteed limit on false rejection.

`features` counts, per whole text, what the rules look at. `certify` turns labelled rows into cutoffs:
for every stratum and rule it walks a fixed grid of cutoffs from lenient to strict and keeps a cutoff
while the exact binomial test rejects "this rule turns away more than `risk / rules` of the stratum's
good documents" at level `delta / (strata x rules)`. Bonferroni corrects over strata and rules, the
fixed sequence over cutoffs, so with confidence 1 - delta no stratum loses more than `risk` of its good
documents to all rules together. Of the certified cutoffs the most lenient one that turns away the most
labelled bad documents is used; with none certified the rule stays silent in that stratum. The labelled
documents are the holdout: nothing else is fitted on them. Equal texts of a stratum are one draw (good only if
every label says so), so copies do not count as independent evidence.

DataFrame functions only. Only the narrow counts are written to the shared folder and joined to labels;
texts are read once and never shuffled. Words are `[^\x20\x09-\x0D]+`. Null or empty text: no words, all
counts 0, base_failed. Null strata are a stratum of their own. Repeated label rows of a document count
once (bad if any says so); rows with a null doc_id have no label. Repeated documents are judged one by one; a
value that equals a cutoff is kept. Very long texts are counted whole, in one row's memory. Extra columns are
ignored. An empty table gives an empty result; without labels only the base rule acts. Three-word windows are
compared by 64-bit hash within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm._common import SPACES, cut, table

RISK = 0.02
DELTA = 0.05
#: Cutoffs from lenient to strict; a document is turned away where its value is above the cutoff.
GRID = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04)
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "shouting": lambda: F.col("n_shouted") / F.greatest("word_chars", F.lit(1)),
    "repeated_lines": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeated_words": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    d = docs.select(*keep, text.alias("_t"), F.split(trimmed, r"[\x20\x09-\x0D]+").alias("_w"))
    d = d.select(
        *keep,
        "_t",
        "_w",
        F.when(F.element_at("_w", 1) == "", F.lit(0)).otherwise(F.size("_w")).cast("long").alias("n_words"),
        F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    d = d.select(
        *keep,
        "n_words",
        "_w",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"[A-Z!]")).cast("long").alias("n_shouted"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(1), (F.col("n_words") - 2).cast("int")),
                lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)),
            ),
        ).alias("_h"),
    )
    counts = [*keep, "n_words", "word_chars", "n_symbols", "n_shouted", "n_lines", "n_dup_lines"]
    # Only texts in which some window returns are sorted.
    d = d.select(
        *counts,
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    d = d.select(
        *counts,
        F.sort_array(
            F.transform(
                F.filter(
                    "_s",
                    lambda x, i: F.get(F.col("_s"), i - 1)["h"].eqNullSafe(x["h"])
                    | F.get(F.col("_s"), i + 1)["h"].eqNullSafe(x["h"]),
                ),
                lambda x: x["i"],
            )
        ).alias("_p"),
    )
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda s: s["n"],
    )
    return d.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly over its k + 1 terms in logarithms."""
    first = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    terms = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda a, i: F.transform(
            F.array(a["t"] + F.ln((n - i + 1) / i) + odds), lambda t: F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))
        )[0],
        lambda a: a["s"],
    )
    return terms


def certify(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from rows of stratum (not null), good (boolean) and a value for each rule."""
    rows = labelled.select(
        "stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")
    )
    grid = F.array(*[F.lit(c) for c in GRID])
    bins = rows.select("stratum", "x.rule", "good", F.size(F.filter(grid, lambda c: c >= F.col("x.v"))).alias("at")).groupBy(
        "stratum", "rule", "at"  # at: the first cutoff that turns the row away, len(GRID) if none does
    ).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    of = Window.partitionBy("stratum", "rule")
    so_far = of.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = delta / len(RULES)
    steps = (
        bins.select("stratum", "rule")
        .distinct()
        .select("*", F.posexplode(F.array_append(grid, F.lit(2.0))).alias("at", "cutoff"))
        .join(bins, ["stratum", "rule", "at"], "left")
        .withColumn("n", F.sum("good").over(of))
        .withColumn("k", F.coalesce(F.sum("good").over(so_far), F.lit(0)))
        .withColumn("caught", F.coalesce(F.sum("bad").over(so_far), F.lit(0)))
        .withColumn("strata", F.size(F.collect_set("stratum").over(Window.partitionBy("rule"))))
        .where(F.col("at") < len(GRID))
    )
    risk_each = risk / len(RULES)
    p = F.when(F.col("k") <= F.col("n") * risk_each, binomial_tail(F.col("k"), F.col("n"), risk_each)).otherwise(F.lit(1.0))
    certified = (
        steps.withColumn("ok", p <= level / F.col("strata"))
        .withColumn("ok", F.min("ok").over(so_far))
        .where("ok AND caught > 0")
        .withColumn("most", F.max("caught").over(of))
        .where("caught = most")
    )
    return certified.groupBy("stratum", "rule").agg(F.max("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: Column, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """`keep` (doc_id among them), the counts, rule values, base_failed, cutoffs met (`failed_rules`) and kept."""
    marked = docs.withColumns({"_stratum": F.coalesce(stratum, F.lit("")), "_md5": F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    f = features(marked, [*keep, "_stratum", "_md5"])
    f = cut(f)  # narrow; the texts are not read again
    f = f.select("*", *[make().alias(r) for r, make in RULES.items()], F.expr(BASE_FAILED).alias("base_failed"))
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).alias("good"))
    )
    holdout = (
        f.where(~F.col("base_failed"))
        .join(known, F.col("doc_id") == F.col("_id"))
        .groupBy(F.col("_stratum").alias("stratum"), "_md5")
        .agg(F.min("good").alias("good"), *[F.min(r).alias(r) for r in RULES])  # equal texts have equal values
    )
    cutoffs = certify(holdout, risk, delta)
    wide = cutoffs.groupBy(F.col("stratum").alias("_s")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES]
    )
    out = f.join(wide, F.col("_stratum") == F.col("_s"), "left").drop("_s", "_md5")
    failed = F.concat_ws(",", *[F.when(F.col(r) > F.col(f"cutoff_{r}"), F.lit(r)) for r in RULES])
    return out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], F.col("lang"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


_VALUES = {
    "symbols": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "shouting": "n_shouted::DOUBLE / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
}
_FEATURES_SQL = r"""
w AS (SELECT doc_id, lang, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM g),
rep AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS o(o) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT doc_id, coalesce(lang, '') AS stratum, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '[A-Z!]', '', 'g')))::BIGINT AS n_shouted,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rw.n, 0)::BIGINT AS n_repeat_words, md5(t) AS m
      FROM l LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)"""


def oracle() -> str:
    """DuckDB SQL for op1: the same counts, and the binomial tail through lgamma."""
    rules = " UNION ALL ".join(f"SELECT doc_id, stratum, m, '{r}' AS rule, {v} AS v, base_failed FROM b" for r, v in _VALUES.items())
    grid = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(GRID))
    a, level = RISK / len(RULES), DELTA / len(RULES)
    return f"""
WITH {_FEATURES_SQL.strip()},
v AS ({rules}),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, rule, m, any_value(v) AS v, bool_and(good) AS good FROM v JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
grid(step, cutoff) AS (VALUES {grid}),
s AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > cutoff) AS k,
        count(*) FILTER (NOT good AND v > cutoff) AS caught FROM h, grid GROUP BY ALL),
t AS (SELECT *, CASE WHEN k <= n * {a} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({a}) + (n - i) * ln(1 - {a}))) FROM (SELECT unnest(range(k + 1)) AS i)) ELSE 1 END
        <= {level} / (SELECT count(DISTINCT stratum) FROM h) AS ok1 FROM s WHERE n > 0),
o AS (SELECT *, bool_and(ok1) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM t),
c AS (SELECT stratum, rule, max(cutoff) AS cutoff FROM (SELECT * FROM o WHERE ok AND caught > 0
        QUALIFY caught = max(caught) OVER (PARTITION BY stratum, rule)) GROUP BY ALL),
z AS (SELECT v.doc_id, string_agg(rule, ',' ORDER BY list_position({list(RULES)!r}, rule)) AS r
      FROM v JOIN c USING (stratum, rule) WHERE v > cutoff GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND z.r IS NULL AS kept, coalesce(z.r, '') AS failed_rules
FROM b LEFT JOIN z USING (doc_id)"""
