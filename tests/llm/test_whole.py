"""What the operators once left out, against brute force."""

import itertools
import random

import pytest

from pointweave.llm import similar

DOCS = "doc_id long, text string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)


def edited_texts(seed=11):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 160))]
        out.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return [None, "", "one two", "one two", *out]


def survivors(texts):
    def sets(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def test_near_duplicate_stage_removes_edited_copies(spark):
    import corpus_pipeline

    given = edited_texts()
    d = docs(spark, given)
    kept = corpus_pipeline.near_duplicates(spark, d, "")
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == survivors(given)
    assert similar.keep_one(docs(spark, given[:0])).count() == 0
    twice = similar.keep_one(docs(spark, given[:4]).unionByName(docs(spark, given[:4])))
    assert sorted(r["doc_id"] for r in twice.collect()) == [0, 2]


@pytest.mark.parametrize("block", [512, 3])
def test_similar_links_in_blocks(spark, block):
    from pointweave.llm import simhash
    from pointweave.llm.common import materialise

    given = edited_texts(12)
    own = docs(spark, given)
    rows = materialise(similar.with_sets(own), "sets")
    found = simhash.named(rows.select("doc_id", "fp"), similar.links(rows, own, block))
    assert sorted({r["component_id"] for r in found.collect()}) == survivors(given)


def toxic_table(spark, n=600, repeat=1):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 900)}" for _ in range(30)]
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(30)] = rng.choice(["scum", "moron", "trash"])
        rows.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")
    return docs(spark, rows), labels


def brute_differences(counts, words):
    """The definition, over all counts: {(before, word): (n0, n1)}."""
    import math

    from pointweave.llm.toxicity import DISCOUNT, LEAN

    vocabulary = {w for _, w in counts}
    shared = {w: sum(1 for _, x in counts if x == w) for w in vocabulary}
    out = []
    for b, w in zip([1, *words], words):
        p = []
        for c in (0, 1):
            behind = {x: sum(1 for (_, y), n in counts.items() if y == x and n[c]) for x in vocabulary}
            rest = sum(min(n, DISCOUNT) for n in behind.values())
            base = (shared.get(w, 0) + 1) / (len(counts) + len(vocabulary) + 1)
            lower = (max(behind.get(w, 0) - DISCOUNT, 0) + (rest + 1) * base) / (sum(behind.values()) + 1)
            own = [n[c] for (x, _), n in counts.items() if x == b]
            left = max(counts.get((b, w), (0, 0))[c] - DISCOUNT, 0)
            p.append((left + (sum(min(n, DISCOUNT) for n in own) + LEAN) * lower) / (sum(own) + LEAN))
        out.append(math.log(p[1] / p[0]))
    return out


def test_toxicity_differences_equal_the_definition(spark):
    import numpy as np

    from pointweave.llm import toxicity

    rng = random.Random(9)
    counts = {(rng.randrange(1, 13), rng.randrange(2, 14)): (rng.choice([0, 1, 3, 5, 9]), rng.choice([1, 2, 4, 30])) for _ in range(70)}
    pairs = spark.createDataFrame([(b << 32 | w, *n) for (b, w), n in counts.items()], "code long, n0 long, n1 long")
    trained = toxicity.train(pairs)
    model = trained.gathered()
    for _ in range(20):
        words = [rng.randrange(2, 17) for _ in range(rng.randrange(1, 9))]
        got = model.differences(np.array(words, np.uint64))
        assert np.allclose(got, brute_differences(counts, words), atol=1e-5)


def test_toxicity_by_joins_equals_by_broadcast(spark):
    from pointweave.llm import toxicity

    d, labels = toxic_table(spark, 300)
    d = d.unionByName(spark.createDataFrame([(None, None, "en"), (7, "", "en"), (7, "scum " * 3000, "en")], DOCS))
    known = labels.where("doc_id % 2 = 0")
    trained, _ = toxicity.toxicity(d, labels)
    one, other = (sorted(map(tuple, toxicity.with_evidence(d, trained, "doc_id", "text", most=m).collect()), key=str) for m in (0, 10**9))
    assert known.count() and len(one) == len(other) == 303
    for a, b in zip(one, other):
        assert a[:2] == b[:2] and all(abs(x - y) < 1e-5 for x, y in zip(a[2:], b[2:]))


def test_toxicity_counts_are_kept_by_key(spark):
    import numpy as np

    from pointweave.llm import toxicity

    # As many words as slots of the former tables. What tells the classes apart is there with all of its counts.
    n = 1 << 19
    codes = np.arange(n, dtype=np.uint64) * np.uint64(4) + np.uint64(2)
    pairs = spark.range(n).selectExpr("shiftleft(id * 4 + 2, 32) | (id * 4 + 6) AS code", "id % 7 AS n0", "id % 5 AS n1")
    model = toxicity.train(pairs).gathered()
    i = np.arange(n)
    telling = np.maximum(i % 7, i % 5) > 3
    at = model.contexts.at(codes)
    assert ((model.contexts.keys[at] == codes) == telling).all()
    assert (model.contexts.values[0, at] == np.where(telling, i % 7, 0)).all() and (model.contexts.values[1, at] == np.where(telling, i % 5, 0)).all()
    left = model.bigrams.values[:, model.bigrams.at(codes << np.uint64(32) | codes + np.uint64(4))]
    assert (left == np.stack([np.maximum(i % 7 - 3, 0), np.maximum(i % 5 - 3, 0)])).all()
    absent = model.bigrams.at(codes << np.uint64(32) | codes)
    assert (model.bigrams.values[:, absent] == 0).all()


def test_toxicity_held_out(spark):
    from pointweave.llm import toxicity

    d, labels = toxic_table(spark)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(d, labels).where("held_out").collect()}
    assert sum(p == (i % 3 == 0) for i, p in got.items()) > 0.95 * len(got)


def test_toxicity_counts_distinct_predecessors(spark):
    from pointweave.llm import toxicity

    # 50 words before "a b", each twice and once more in copies; 40 copies of one text.
    given = [f"p{i % 50} a b" for i in range(100)] + ["p0 a b"] * 300 + ["q a c"] * 40
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(given)], "text string, toxic long")
    memo = toxicity._Words()
    a, b, c = (memo[w] for w in "abc")
    found = {r["code"] & (2**64 - 1): (r["n0"], r["n1"]) for r in toxicity.bigram_counts(rows.repartition(5)).collect()}
    # p0, p2, ... are ordinary, p1, p3, ... toxic; the copies of p0 are both.
    assert found[a << 32 | b] == (25, 26) and found[a << 32 | c] == (1, 1)
    more = spark.createDataFrame([(f"p{i} a b", 0) for _ in range(3) for i in range(500)], "text string, toxic long")
    assert {r["code"] & (2**64 - 1): r["n0"] for r in toxicity.bigram_counts(more).collect()}[a << 32 | b] == 500
