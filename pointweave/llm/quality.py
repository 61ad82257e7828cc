"""Operator 4, quality rules with risk-controlled thresholds. Native: DataFrame functions only.

Each rule rejects a document whose rate is over a cutoff. Cutoffs come from labelled documents that
nothing else was fitted to: per stratum (language) and rule, the candidate cutoffs are tried from the
most lenient to stricter ones, and a cutoff stands as long as the exact binomial test rejects "it would
drop more than the allowed share of good documents": P(X <= k | n, share) <= level, k of n good
holdout documents being over the cutoff. Trying in a fixed order needs no correction inside a rule;
the family-wise error is split over strata and rules (Bonferroni), the allowed share over rules. So with
probability 1 - ERROR no stratum loses more than RISK of its good documents to the rules. Where the
holdout is too small to certify anything, a rule stays silent.

Counts are taken inside each row, so long texts and hot sources need no shuffle; the holdout is
summed by a grouped aggregate with one row for each stratum. Strata are a fixed list and one for all others, so
the table of cutoffs has that many rows and is broadcast.

Five-word windows are compared by 64-bit hashes within a document.

Defined results: null text has no words; empty texts fail the base rule; labels that are null or whose document is
missing take no part, and of repeated labels the lowest quality counts; repeated rows are judged alike; an
empty table gives no rows; extra columns stay and clashing ones are hidden behind the operator's names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_CHARS, WHITE_CLASS, materialise, table

STRATA = ("en", "de", "fr", "es")
#: Share of good documents of a stratum that all rules together may drop, and the chance that it is more.
RISK, ERROR = 0.02, 0.05
#: Per rule: numerator, denominator and candidate cutoffs in thousandths, lenient to strict.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", (3000, 2500, 2000, 1500, 1000, 800, 600, 400, 300, 200, 150, 100, 50)),
    "shouts": ("n_shouts", "n_words", (3000, 2500, 2000, 1500, 1000, 800, 600, 400, 300, 200, 150, 100, 50)),
    "repeats": ("n_repeat_words", "n_words", (190, 170, 150, 130, 110, 90, 70, 50)),
    "lines": ("n_dup_lines", "n_words", (500, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10)),
    "lengths": ("word_chars", "n_words", (40000, 30000, 25000, 20000, 17000, 15000, 13000, 12000, 11000, 10000)),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts")
WINDOW = 5
#: Labels of at most 16 bytes each that are broadcast.
BROADCAST_LABELS = 1_000_000
TERMS = 2000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def window_starts(ordered: Column) -> Column:
    """Sorted starts of the windows whose hash occurs twice or more; ordered: sorted structs (h, i)."""

    def start(e: Column, j: Column) -> Column:
        def equal(k: Column) -> Column:
            return F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))

        return F.when(equal(j - 1) | equal(j + 1), e["i"])

    return F.array_sort(F.filter(F.transform(ordered, start), lambda x: x.isNotNull()))


def words_covered(starts: Column) -> Column:
    """How many words the windows at these sorted starts cover."""
    widths = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)


def with_features(docs: DataFrame) -> DataFrame:
    """Adds the FEATURES as longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    signs = F.regexp_replace(text, r"[^#*$%&|<>!]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    out = docs.withColumns(
        {
            "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE_CLASS}]+")),
            "__signs": signs,
            "__lines": lines,
        }
    )
    hashed = F.transform("__words", lambda w: F.xxhash64(w))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_shouts": (F.length("__signs") - F.length(F.translate("__signs", "!", ""))).cast("long"),
            "n_symbols": F.length(F.translate("__signs", "!", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__words": hashed,
        }
    ).drop("__signs", "__lines")
    count = F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0))
    words = F.col("__words")
    out = out.withColumn("__windows", F.transform(F.slice(words, F.lit(1), count), lambda h, i: F.xxhash64(h, *[F.get(words, i + k) for k in range(1, WINDOW)]))).drop("__words")
    # Most texts repeat no window; the others are sorted by hash, so that repeats stand side by side.
    windows, ordered, starts = F.col("__windows"), F.col("__ordered"), F.col("__starts")
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__ordered", F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed)).drop("__windows")
    out = out.withColumn("__starts", F.when(ordered.isNotNull(), window_starts(ordered))).drop("__ordered")
    covered = F.when(starts.isNotNull(), words_covered(starts)).otherwise(F.lit(0).cast("long"))
    return out.withColumn("n_repeat_words", covered).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def over(rule: str, cutoff: int | Column) -> Column:
    value, per, _ = RULES[rule]
    return F.col(value) * 1000 > F.col(per) * cutoff


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought down by the recurrence; error under 1e-12."""
    z = n + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    big = z * F.ln(z) - z + F.ln(z * (2 * 3.141592653589793)) / 2 + series
    return big - sum(F.ln(n + float(k)) for k in range(1, 9))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n draws with probability p, from above if k is far below n p; 1 if k >= n p.

    Terms fall from i = k downwards. After TERMS of them the rest is bounded by a geometric sum.
    """
    odds = (1 - p) / p
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, i: Column) -> Column:
        below = acc["term"] * (k - i) / (n - k + i + 1) * odds
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), below.alias("term"))

    ratio = k / (n - k + 1) * odds
    whole = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int")), zero, add)
    tail = F.when(k > TERMS, whole["term"] / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(first * (whole["sum"] + tail))


def cutoffs(rated: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each stratum of the holdout: stratum, n_good and per rule its certified cutoff or null.

    rated: doc_id, stratum and features.
    """
    share, level = risk / len(RULES), error / (len(RULES) * (len(STRATA) + 1))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = rated.where(~base_failed()).join(known.where("quality = 1").select("doc_id"), "doc_id")
    counts = [F.sum(over(rule, c).cast("long")).alias(f"{rule}_{c}") for rule, (_, _, grid) in RULES.items() for c in grid]
    summed = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    best = []
    for rule, (_, _, grid) in RULES.items():
        tried = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"{rule}_{c}").cast("double").alias("k")) for c in grid])
        # Stricter cutoffs drop more, so those that pass stand before those that fail.
        passed = F.filter(tried, lambda x: binomial_tail(x["k"], F.col("n_good").cast("double"), share) <= level)
        best.append(F.array_min(F.transform(passed, lambda x: x["cutoff"])).alias(rule))
    return summed.select("stratum", "n_good", *best)


def judge(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with features; chosen: cutoffs()."""
    renamed = chosen.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES])
    joined = docs.join(F.broadcast(renamed), stratum(F.col("lang")) == F.col("__stratum"), "left")
    dropped = F.lit(False)
    for rule in RULES:
        dropped = dropped | F.coalesce(over(rule, F.col(f"__{rule}")), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~dropped}).drop("__stratum", *[f"__{r}" for r in RULES])


def rated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang, stratum and features, written once."""
    own = docs.select("doc_id", "lang", "text", stratum(F.col("lang")).alias("stratum"))
    return materialise(with_features(own).drop("text"), "rated")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    # Only labelled rows feed the cutoffs. With few labels only theirs are rated first; many would cost a shuffle of all texts.
    few = labels.count() <= BROADCAST_LABELS
    labelled = docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi") if few else docs
    chosen = materialise(cutoffs(rated_documents(labelled), labels), "cutoffs")
    own = docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text", "lang")
    # A filter must not be pushed below the features, where each of their nested uses would be evaluated anew;
    # it cannot pass a projection with a column that is not deterministic.
    rated = with_features(own).withColumn("__place", F.monotonically_increasing_id())
    return judge(rated, chosen).where(F.col("kept") & (F.col("__place") >= 0)).select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rated_documents(table(spark, sf_dir, "documents"))
    judged = judge(rated, cutoffs(rated, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    share, level = RISK / len(RULES), ERROR / (len(RULES) * (len(STRATA) + 1))
    space = "[\\x20\\x09-\\x0D]"
    strata = ", ".join(f"'{s}'" for s in STRATA)
    value = {r: (v, per) for r, (v, per, _) in RULES.items()}
    grid = ", ".join(f"('{r}', {c})" for r, (_, _, g) in RULES.items() for c in g)
    rate = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v} * 1000 > {per} * cutoff" for r, (v, per) in value.items()) + " END"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2], ws[p + 3], ws[p + 4]) AS c FROM pos),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2, p + 3, p + 4]) AS q FROM win WHERE c > 1) GROUP BY rid),
f AS (SELECT w.rid, doc_id, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
good AS (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
tried AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({rate}) AS k FROM good CROSS JOIN grid GROUP BY ALL),
best AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tried WHERE k < n * {share!r} AND {tail} <= {level!r} GROUP BY stratum, rule),
dropped AS (SELECT DISTINCT rid FROM b JOIN best USING (stratum) WHERE {rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dropped.rid IS NULL AS kept
FROM b LEFT JOIN dropped ON b.rid = dropped.rid"""


ORACLE_SQL = _sql()
