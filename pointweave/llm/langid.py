"""Operator 6, language identification by Bayesian evidence fusion.

The posterior of a page's language is proportional to
text likelihood x P(declared markup language | language) x P(address suffix | language) x host prior.

Text: words and their letter trigrams, hashed to SLOTS slots, counted per language over all labelled
documents; a page's likelihood is its mean per feature times TEXT_WEIGHT features, so that long pages
do not drown the other evidence. Scripts, styles, heads, navigation, footers, asides, comments and blocks whose class says
advertising are no text. The other tables are counted over all pages by their text-only
posterior, as grouped sums: declared language by language, suffix by language, and host priors that
shrink to the domain's (the last two labels of the host), which shrink to all pages'. The suffix is evidence of its own, so
priors don't shrink to it. A page's own share is taken out of every table before the page is judged by it.

Languages are a fixed list. Slot counts (at most SLOTS rows) and the declared table (languages + 2 rows) have
fixed bounds; host tables are joined by shuffles, salted so that a hot host is met by many tasks.

Defined results: null html has no text and null addresses have the host ''; a page without any evidence gets the
largest prior; ties go to the earlier language of the list; repeated rows are judged alike and count each; a very long
page is read whole, in time linear in it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, materialise, slices, table, text_or_empty

LANGUAGES = ("en", "de", "fr", "es")
BITS = 16
SLOTS = 1 << BITS
TEXT_WEIGHT = 12.0
HOST_PULL, DOMAIN_PULL = 5.0, 20.0
SMOOTH = 0.5
SALTS = 16
MEMO_WORDS = 200_000

#: What no reader reads, or what stands around the page's own text: elements, comments, and blocks marked as advertising.
OPENING = re.compile(
    r"(?i)<!--|<(script|style|head|nav|footer|aside)\b|<(div|section)\s[^<>]{0,200}?class\s*=\s*[\"']?(?:[\w-]{1,60}\s+){0,4}(?:ad|ads|advert|advertisement|sponsored)[\s\"'>]"
)
TAG = re.compile(r"(?s)<[^>]*>")
WORD = re.compile(r"[^\W\d_]+")


def visible_text(html: str) -> str:
    """The text outside of skipped parts and tags, in time linear in the html: each closing is searched for once.

    A skipped part ends at the first closing of its kind; one that is never closed isn't skipped, only its tag is.
    """
    kept, at, ends = [], 0, {}
    for opening in OPENING.finditer(html):
        if opening.start() < at:
            continue
        closing = "-->" if opening[0] == "<!--" else f"</{(opening[1] or opening[2]).lower()}"
        end = ends.get(closing)
        if end is None or 0 <= end < opening.end():
            found = re.compile(re.escape(closing) + ("" if closing == "-->" else r"\s*>"), re.I).search(html, opening.end())
            end = ends[closing] = found.end() if found else -1
        if end >= 0:
            kept += [html[at : opening.start()], " "]
            at = end
    rest = "".join([*kept, html[at:]])
    closed = rest.rfind(">") + 1  # behind the last tag's end no "<" opens one, and before it every one ends
    return entities.unescape(TAG.sub(" ", rest[:closed]) + rest[closed:])


def features(word: str) -> list[int]:
    """Slots of a word and of its letter trigrams."""
    w = f"<{word}>"
    return [crc32(x.encode()) % SLOTS for x in [w, *(w[i : i + 3] for i in range(len(w) - 2))]]


def feature_counts(docs: DataFrame) -> DataFrame:
    """lang, slot, n over all documents of the listed languages."""

    def run(batches):
        memo: dict[str, list[int]] = {}
        for batch in batches:
            sums = {k: np.zeros(SLOTS, dtype=np.int64) for k in LANGUAGES}
            for part in slices(batch):
                words = {k: Counter() for k in LANGUAGES}
                for text, lang in zip(field(part, "text").to_pylist(), field(part, "lang").to_pylist()):
                    words[lang].update(WORD.findall(text.lower()))
                for lang, counter in words.items():
                    at, by = [], []
                    for word, n in counter.items():
                        known = memo.get(word)
                        if known is None:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            known = memo[word] = features(word)
                        at += known
                        by += [n] * len(known)
                    if at:
                        sums[lang] += np.bincount(at, by, SLOTS).astype(np.int64)
            for lang, own in sums.items():
                some = np.nonzero(own)[0]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(own[some])], names=["lang", "slot", "n"])

    known = docs.where(F.col("lang").isin(*LANGUAGES)).select(text_or_empty().alias("text"), "lang")
    return known.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def likelihoods(counts: DataFrame) -> np.ndarray:
    """ln P(slot | language), one column for each language."""
    t = counts.toArrow()
    out = np.full((SLOTS, len(LANGUAGES)), SMOOTH)
    place = {k: i for i, k in enumerate(LANGUAGES)}
    out[t["slot"].to_numpy(), [place[x] for x in t["lang"].to_pylist()]] += t["n"].to_numpy()
    return np.log(out / out.sum(axis=0))


def with_text_evidence(pages: DataFrame, table_: np.ndarray) -> DataFrame:
    """page_id, url, declared and ll (mean log-likelihood of each language, null without a feature)."""
    shared = pages.sparkSession.sparkContext.broadcast(table_)

    def run(batches):
        logs, memo = shared.value, {}
        for batch in batches:
            for part in slices(batch):
                found = []
                for html in field(part, "html").to_pylist():
                    total, n = np.zeros(len(LANGUAGES)), 0
                    for word, k in Counter(WORD.findall(visible_text(html or "").lower())).items():
                        known = memo.get(word)
                        if known is None:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            at = features(word)
                            known = memo[word] = (logs[at].sum(axis=0), len(at))
                        total += k * known[0]
                        n += k * known[1]
                    found.append((total / n).tolist() if n else None)
                columns = [field(part, "page_id"), field(part, "url"), field(part, "declared"), pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "declared", "ll"])

    tag = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", 1))
    declared = F.when(F.coalesce(tag, F.lit("")) == "", "none").when(tag.isin(*LANGUAGES), tag).otherwise("other")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), declared.alias("declared"), "html")
    return rows.mapInArrow(run, "page_id long, url string, declared string, ll array<double>")


def softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, lang and its posterior probability."""
    many, L = range(len(LANGUAGES)), len(LANGUAGES)
    read = with_text_evidence(pages, likelihoods(feature_counts(docs)))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    text = [F.coalesce(F.get("ll", F.lit(i)) * TEXT_WEIGHT, F.lit(0.0)) for i in many]
    rows = read.select("page_id", host.alias("host"), "declared", *[t.alias(f"t{i}") for i, t in enumerate(text)])
    soft = softmax([F.col(f"t{i}") for i in many])
    rows = materialise(rows.select("*", *[p.alias(f"p{i}") for i, p in enumerate(soft)]), "evidence")

    def summed(df: DataFrame, key: list[str], source: str, name: str) -> DataFrame:
        return df.groupBy(*key).agg(*[F.sum(f"{source}{i}").alias(f"{name}{i}") for i in many])

    def total(name: str) -> Column:
        return sum((F.col(f"{name}{i}") for i in range(1, L)), F.col(f"{name}0"))

    # Address tables: one row for each host, with its domain's and its suffix's counts beside its own.
    hosts = summed(rows, ["host"], "p", "h")
    hosts = hosts.select("*", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"))
    hosts = materialise(hosts, "hosts")
    domains = summed(hosts, ["domain", "suffix"], "h", "d")
    suffixes = materialise(summed(hosts, ["suffix"], "h", "s"), "suffixes")
    overall = suffixes.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"a{i}") for i in many]).first()
    base = [(overall[f"a{i}"] + SMOOTH) / (sum(overall) + SMOOTH * L) for i in many]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # One suffix, or one domain of many hosts, may hold a large part of them.
    placed = hosts.withColumn("own", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    placed = placed.join(domains.withColumn("own", salts), ["domain", "suffix", "own"]).join(suffixes.withColumn("own", salts), ["suffix", "own"])
    salted = placed.withColumn("salt", salts).drop("domain", "own")
    seen = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])

    names = ["none", "other", *LANGUAGES]
    marked = rows.groupBy("declared").agg(*[F.sum(f"p{i}").alias(f"m{i}") for i in many]).collect()
    by_mark = {r["declared"]: r for r in marked}
    marks = [sum(r[f"m{i}"] for r in marked) for i in many]
    kinds = max(1, suffixes.count())
    logs = []

    def less_own(table_: str, i: int) -> Column:
        return F.greatest(F.col(f"{table_}{i}") - F.col(f"p{i}"), F.lit(0.0))

    def less_all(table_: str) -> Column:
        return F.greatest(total(table_) - total("p"), F.lit(0.0))

    for i in many:
        mark = F.lit(0.0)
        for x in names:
            mark = F.when(F.col("declared") == x, F.lit(float(by_mark[x][f"m{i}"] if x in by_mark else 0.0))).otherwise(mark)
        rest = F.greatest(F.lit(float(marks[i])) - F.col(f"p{i}"), F.lit(0.0))
        declared = (F.greatest(mark - F.col(f"p{i}"), F.lit(0.0)) + SMOOTH) / (rest + SMOOTH * len(names))
        given = (less_own("s", i) + SMOOTH) / (rest + SMOOTH * kinds)
        domain = (less_own("d", i) + DOMAIN_PULL * base[i]) / (less_all("d") + DOMAIN_PULL)
        prior = (less_own("h", i) + HOST_PULL * domain) / (less_all("h") + HOST_PULL)
        logs.append((F.col(f"t{i}") + F.ln(declared) + F.ln(given) + F.ln(prior)).alias(f"l{i}"))
    fused = seen.select("page_id", "host", "declared", *logs)
    posterior = softmax([F.col(f"l{i}") for i in many])
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(posterior)]))
    out = fused.select("page_id", "host", "declared", best.alias("best"))
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), 1 - F.col("best.i"))
    return out.select("page_id", "host", "declared", language.alias("lang"), F.col("best.p").alias("probability"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
