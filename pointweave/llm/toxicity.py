"""Operator 7, toxicity: class-conditional Kneser-Ney models.

A toxic and an ordinary bigram model are counted over all labelled training texts. Both discount bigrams
into their class's continuation counts and those into continuation counts shared by both classes, so a
rare expression is judged alike unless its class says otherwise. A text's evidence is the difference
of the models' log-likelihoods per word: over the whole text, over its most toxic stretch of WINDOW
words, and over its most toxic words; a logistic curve fitted on other labelled texts makes it a score.

Counts are kept by key, exact and without shared slots, as written tables that grow with the input. Tables of up to
BROADCAST_ROWS rows are gathered into sorted arrays for every worker; larger ones are joined to the words of all texts.
Labels are broadcast up to BROADCAST_LABELS rows, beyond that joined by a shuffle.

Training rows are those with crc32(doc_id) mod 3 = 0 for the counts and = 2 for the curve; = 1 is held out.
The curve is fitted on at most CURVE_ROWS rows, distinct ones with the smallest hashes.

Defined results: null and empty texts have no evidence and get the score of none; null labels take no part, of repeated labels
the most toxic counts; without both classes in both folds the score is the base rate and under 0.7; repeated rows are scored
alike; a very long text is scored whole, in memory linear in it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, materialise, slices, table, text_or_empty

DISCOUNT = 3.0
LEAN = 20.0
WINDOW, PEAKS = 16, 4
EVIDENCE = 5
#: No single word speaks louder.
LARGEST = 6.0
CURVE_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
#: Rows of the model, of at most 40 bytes each, that are gathered and broadcast.
BROADCAST_ROWS = 4_000_000
SALTS = 16
MEMO_WORDS = 400_000
THRESHOLD = 0.7
START = 1


class _Words(dict):
    """white-space word -> 32-bit hash of its lower-case letters and digits; 0 if it has none."""

    strip = re.compile(r"^[\W_]+|[\W_]+$")

    def __missing__(self, word: str) -> int:
        bare = self.strip.sub("", word).lower()
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = crc32(bare.encode()) | 2 if bare else 0
        if len(word) < 64:
            self[word] = out
        return out


def word_codes(text: str, memo: _Words) -> np.ndarray:
    words = text.split()
    codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    return codes[codes != 0]


def pair_codes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word with its predecessor; the first one's is START."""
    return np.concatenate([[np.uint64(START)], words[:-1]]).astype(np.uint64), words


def bigram_counts(docs: DataFrame) -> DataFrame:
    """code (predecessor << 32 | word, as a signed long) and its counts n0 and n1 under either label.

    A bigram counts as often as distinct words stood before it, so that copies of one text count once, at every size. Its
    distinct (word before, bigram) are grouped first, then counted; both steps sum up before they shuffle.
    """

    def run(batches):
        memo = _Words()
        for batch in batches:
            for part in slices(batch, 2048):
                codes, firsts, toxic = [], [], []
                for text, label in zip(field(part, "text").to_pylist(), field(part, "toxic").to_pylist()):
                    words = word_codes(text, memo)
                    if len(words):
                        before, own = pair_codes(words)
                        codes.append(before << np.uint64(32) | own)
                        firsts.append(pair_codes(before)[0])
                        toxic.append(np.full(len(own), 2 if label == 1 else 1, np.int8))
                if codes:
                    code, first, label = np.concatenate(codes), np.concatenate(firsts), np.concatenate(toxic)
                    order = np.lexsort((first, code))
                    code, first, label = code[order], first[order], label[order]
                    starts = np.nonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (first[1:] != first[:-1])]))[0]
                    labels = np.bitwise_or.reduceat(label, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code[starts].view(np.int64), first[starts].view(np.int64), labels)], names=["code", "first", "labels"])

    rows = docs.select("text", "toxic").mapInArrow(run, "code long, first long, labels byte")
    distinct = rows.groupBy("code", "first").agg(F.bit_or("labels").alias("labels"))
    counts = [F.sum((F.col("labels").bitwiseAND(F.lit(b).cast("byte")) > 0).cast("long")).alias(f"n{c}") for c, b in ((0, 1), (1, 2))]
    return distinct.groupBy("code").agg(*counts)


class Table:
    """Counts of both classes by key; a key that isn't there has those of the last column."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: float | np.ndarray = 0.0):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.column_stack([values[:, order], np.broadcast_to(absent, len(values))]).astype(np.float32)

    def at(self, keys: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.keys, keys)
        return np.where(self.keys[found] == keys, found, len(self.keys) - 1)


class Model:
    """Tables of both classes, and the log-likelihood differences of word sequences."""

    def __init__(self, bigrams: Table, contexts: Table, words: Table):
        """bigrams: what the discount left; contexts: counts of both classes, then what it freed; words: the lower order."""
        self.bigrams, self.contexts, self.words = bigrams, contexts, words

    def differences(self, words: np.ndarray) -> np.ndarray:
        before, own = pair_codes(words)
        left = self.bigrams.values[:, self.bigrams.at(before << np.uint64(32) | own)]
        contexts, lower = self.contexts.values[:, self.contexts.at(before)], self.words.values[:, self.words.at(own)]
        # LEAN more counts are given to the lower order, so that rare contexts lean on it.
        logs = [np.log((left[c] + (contexts[2 + c] + LEAN) * lower[c]) / (contexts[c] + LEAN)) for c in (0, 1)]
        return logs[1] - logs[0]


def evidence(differences: np.ndarray) -> tuple[float, ...]:
    """Per word: of the whole text, its most toxic stretch, its most toxic PEAKS words, the most toxic one; log of the length."""
    if not len(differences):
        return (0.0,) * EVIDENCE
    d = np.minimum(differences.astype(np.float64), LARGEST)
    sums = np.concatenate([[0.0], np.cumsum(d)])
    width = min(WINDOW, len(d))
    stretch = (sums[width:] - sums[:-width]).max() / WINDOW
    peaks = np.partition(d, len(d) - PEAKS)[-PEAKS:] if len(d) > PEAKS else d
    return d.mean(), stretch, np.maximum(peaks, 0).sum() / PEAKS, d.max(), np.log1p(len(d))


class Trained:
    """The model as written tables (key, c0, c1, ...), with what an absent word has, and whether both classes were seen."""

    def __init__(self, bigrams: DataFrame, contexts: DataFrame, words: DataFrame, absent: tuple[float, float], both: bool):
        self.bigrams, self.contexts, self.words, self.absent, self.both = bigrams, contexts, words, absent, both

    def rows(self) -> int:
        return sum(t.count() for t in (self.bigrams, self.contexts, self.words))

    def gathered(self) -> Model:
        def table_(rows: DataFrame, n: int, absent: object = 0.0) -> Table:
            t = rows.toArrow()
            return Table(t["key"].to_numpy().view(np.uint64), np.stack([t[f"c{i}"].to_numpy() for i in range(n)]).astype(float), absent)

        return Model(table_(self.bigrams, 2), table_(self.contexts, 4), table_(self.words, 2, np.array(self.absent)))


def train(pairs: DataFrame) -> Trained:
    """pairs: bigram_counts(), written.

    Only rows that can tell the classes apart are kept, which changes no difference: bigrams that the discount leaves
    something of, contexts that such a bigram gives a count, and words that end one or that stand behind more contexts than the
    discount takes. To all others both classes give the same share of the shared counts.
    """
    context, word = F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    take = lambda c: F.least(F.col(c).cast("double"), F.lit(DISCOUNT))
    left = [F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0)).cast("double") for c in ("n0", "n1")]
    bigrams = pairs.select(F.col("code").alias("key"), left[0].alias("c0"), left[1].alias("c1")).where("c0 > 0 or c1 > 0")
    sums = [F.sum(F.col("n0").cast("double")), F.sum(F.col("n1").cast("double")), F.sum(take("n0")), F.sum(take("n1"))]
    contexts = pairs.groupBy(context.alias("key")).agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).where("c0 > c2 or c1 > c3")
    some = [F.sum((F.col(c) > 0).cast("long")).alias(f"k{i}") for i, c in enumerate(("n0", "n1"))]
    ends = F.max((F.greatest("n0", "n1") > DISCOUNT).cast("int")).alias("ends")
    words = materialise(pairs.groupBy(word.alias("key")).agg(*some, F.count("*").alias("shared"), ends), "words")
    totals = [F.coalesce(F.sum(x), F.lit(0.0)).cast("double") for x in (F.col("k0"), F.col("k1"), take("k0"), take("k1"), F.col("shared"))]
    k0, k1, rest0, rest1, shared, n = words.agg(*totals, F.count("*")).first()
    base = (F.col("shared") + 1.0) / (shared + n + 1)
    lower = [(F.greatest(F.col(f"k{c}") - F.lit(DISCOUNT), F.lit(0.0)) + (rest + 1) * base) / (k + 1) for c, rest, k in ((0, rest0, k0), (1, rest1, k1))]
    telling = words.where((F.greatest("k0", "k1") > DISCOUNT) | (F.col("ends") > 0)).select("key", lower[0].alias("c0"), lower[1].alias("c1"))
    absent = tuple((rest + 1) / (shared + n + 1) / (k + 1) for rest, k in ((rest0, k0), (rest1, k1)))
    tables = [materialise(t, tag) for t, tag in ((bigrams, "telling-bigrams"), (contexts, "telling-contexts"), (telling, "telling-words"))]
    return Trained(*tables, absent, k0 > 0 and k1 > 0)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression by Newton's method; the last is the intercept."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - scaled @ centre)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def with_evidence(docs: DataFrame, trained: Trained, *keep: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The kept columns and the evidence e0, e1, ... of every row.

    Tables of up to ``most`` rows together go to every worker; larger ones stay where they are, and the words of all
    texts meet them by joins.
    """
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    schema = rows.drop("__text").schema
    for i in range(EVIDENCE):
        schema = schema.add(f"e{i}", "double")

    def batch_of(part, found: list) -> pa.RecordBatch:
        columns = np.array(found).reshape(-1, EVIDENCE)
        return pa.RecordBatch.from_arrays([field(part, k) for k in keep] + [pa.array(columns[:, i]) for i in range(EVIDENCE)], names=[*keep, *(f"e{i}" for i in range(EVIDENCE))])

    if trained.rows() > most:
        numbered = materialise(rows.withColumn("__rid", F.monotonically_increasing_id()), "texts")

        def judged(batches):
            for batch in batches:
                for part in slices(batch, 64):
                    yield batch_of(part, [evidence(np.array(d or [])) for d in field(part, "__d").to_pylist()])

        return numbered.drop("__text").join(joined_differences(numbered, trained), "__rid", "left").mapInArrow(judged, schema)
    shared = docs.sparkSession.sparkContext.broadcast(trained.gathered())

    def run(batches):
        own, memo = shared.value, _Words()
        for batch in batches:
            for part in slices(batch, 1024):
                yield batch_of(part, [evidence(own.differences(word_codes(t, memo))) for t in field(part, "__text").to_pylist()])

    return rows.mapInArrow(run, schema)


def joined_differences(numbered: DataFrame, trained: Trained) -> DataFrame:
    """(__rid, __d) of rows (__rid, __text) with a word: Model.differences by joins, for tables of any size.

    Frequent words would be hot keys, so the model's rows are copied SALTS times and the words' rows spread over the copies.
    """

    def run(batches):
        memo = _Words()
        for batch in batches:
            for part in slices(batch, 256):
                for rid, text in zip(field(part, "__rid").to_pylist(), field(part, "__text").to_pylist()):
                    words = word_codes(text, memo)
                    if not len(words):
                        continue
                    before, own = (x.view(np.int64) for x in pair_codes(words))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rid)), pa.array(np.arange(len(own))), pa.array(before), pa.array(own)], names=["rid", "pos", "before", "own"])

    tokens = numbered.select("__rid", "__text").mapInArrow(run, "rid long, pos long, before long, own long")
    tokens = tokens.withColumn("code", F.shiftleft("before", 32).bitwiseOR(F.col("own"))).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    for tag, key, rows in (("b", "code", trained.bigrams), ("c", "before", trained.contexts), ("w", "own", trained.words)):
        copies = rows.select(F.col("key").alias(key), *[F.col(c).cast("float").cast("double").alias(f"{tag}{c}") for c in rows.columns[1:]])
        tokens = tokens.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], "left")
    at = lambda c, default=0.0: F.coalesce(F.col(c), F.lit(float(default)))
    logs = [F.ln((at(f"bc{c}") + (at(f"cc{2 + c}") + LEAN) * at(f"wc{c}", trained.absent[c])) / (at(f"cc{c}") + LEAN)) for c in (0, 1)]
    placed = tokens.select("rid", F.struct("pos", (logs[1] - logs[0]).alias("d")).alias("at"))
    return placed.groupBy(F.col("rid").alias("__rid")).agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["d"]).alias("__d"))


def labelled(docs: DataFrame, labels: DataFrame, fold: int) -> DataFrame:
    """doc_id, text and toxic of the documents with a label in a fold."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) == fold)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    few = labels.count() <= BROADCAST_LABELS
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(own) if few else own, "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame) -> tuple[Trained, Column]:
    """The trained model and the score as an expression of the evidence."""
    labels = labels.select("doc_id", "toxic").where("toxic in (0, 1)")
    pairs = materialise(bigram_counts(labelled(docs, labels, 0)), "bigrams")
    model = train(pairs)
    curve = labelled(docs, labels, 2).withColumn("__h", F.xxhash64("doc_id", "text"))
    last = curve.select("__h").distinct().orderBy("__h").limit(CURVE_ROWS).agg(F.max("__h")).first()[0]
    curve = curve.where(F.col("__h") <= F.lit(last).cast("long")).dropDuplicates(["__h"])
    t = with_evidence(curve, model, "toxic").toArrow()
    y = t["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2 or not model.both:
        return model, F.lit(min(0.5, (y.sum() + 0.5) / (len(y) + 1.0)))
    w = fit_curve(np.column_stack([t[f"e{i}"].to_numpy() for i in range(EVIDENCE)]), y)
    z = sum((F.col(f"e{i}") * float(w[i]) for i in range(EVIDENCE)), F.lit(float(w[EVIDENCE])))
    return model, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, score = toxicity(docs, labels)
    scored = with_evidence(docs, model, "doc_id").select("doc_id", (remainder(F.coalesce("doc_id", F.lit(0))) == 1).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns."""
    model, score = toxicity(docs, labels)
    own = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return with_evidence(own, model, "__row").where(score < THRESHOLD).select("__row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
