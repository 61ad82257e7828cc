"""Small tables with nulls, empty texts, ties, repeated rows and clashing column names, against brute force."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import pytest

from pointweave.llm import chat, langid, packing, quality, sharding, simhash, spbpe, tokenbin, topk, toxicity
from pointweave.llm.common import vocabulary

WORD, PIECE = "word_bpe_49k.json", "piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, kept boolean"


def docs(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or ""), 1, 2, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["idiot", "the", "á", "漢字", "<s>", "İ"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " \n\t", *out, out[0], out[0], "x " * 3000, "a-b " * 5000]


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORD)).encode(text or "", add_special_tokens=False).ids + [2]


def whole_pieces(rows, given):
    """Every id in one piece, sequences gapless, checksums right."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(given)
    for doc, own in by_doc.items():
        ids, at = ids_of(given[doc]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_sequence)


def test_packing(spark):
    given = texts()
    rows = packing.pack_documents(docs(spark, given), vocabulary(WORD)).collect()
    n = whole_pieces(rows, given)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1
    assert packing.pack_documents(docs(spark, []), vocabulary(WORD)).count() == 0


def test_lengths_are_placed_once():
    counts = {4096: 2, 3000: 5, 2000: 3, 1000: 9, 7: 1000, 1: 50}
    runs = packing.place_lengths(counts)
    seen, room = {}, {}
    for length, rank, count, first, offset in runs:
        for k in range(count):
            assert (length, rank + k) not in seen
            seen[length, rank + k] = first + k
            assert room.get(first + k, 0) == offset
            room[first + k] = offset + length
    assert {n: sum(1 for a, _ in seen if a == n) for n in counts} == counts and max(room.values()) <= 4096


def test_token_binary(spark):
    given = texts(2)
    packed = tokenbin.packed_sequences(docs(spark, given).coalesce(2), vocabulary(WORD), window=50_000)
    rows = tokenbin.segment_rows(packed).collect()
    whole_pieces(rows, given)
    assert all(r["resets"] for r in rows)
    assert tokenbin.packed_sequences(docs(spark, []), vocabulary(WORD)).count() == 0


def test_best_fit():
    packs = tokenbin.best_fit_decreasing([5, 3, 8, 2, 2], 10)
    assert sorted(sorted(p) for p in packs) == [[0, 1], [2, 3], [4]] or sum(map(len, packs)) == 5 and len(packs) == 2


def test_sharding(spark):
    given = texts()
    rows = sharding.shard_documents(docs(spark, given)).collect()
    assert len(rows) == len(given)
    for r in rows:
        raw = (given[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["grown_shard"] in (r["shard"], 16)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), lambda r: r["shard"]):
        own = list(own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_weighted_shards(spark):
    df = sharding.with_digest(spark.range(4000).toDF("k"), "k")
    shares = {r["s"]: r["count"] for r in sharding.rendezvous(df, {"s": [1.0, 3.0]}).groupBy("s").count().collect()}
    assert 0.7 < shares[1] / 4000 < 0.8


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE))
    given = [*texts(), "  lead", "trail  ", "a▁b", "x" * 5000, "\x00\n😀 ﬁ", "<0x0A></s>"]
    rows = spbpe.encode_documents(docs(spark, given), vocabulary(PIECE), with_texts=True).collect()
    for r in rows:
        ids = model.encode(given[r["doc_id"]] or "") + [2]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == model.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert spbpe.encode_documents(docs(spark, []), vocabulary(PIECE)).count() == 0


def test_quality_features(spark):
    line = "one two three four five six"
    given = [None, "", f"{line}\n{line}\n \n", "a b c d e f a b c d e", "## ok! <b>", "é " * 12]
    rows = {r["doc_id"]: r for r in quality.with_features(docs(spark, given)).collect()}
    assert [rows[i]["n_words"] for i in range(6)] == [0, 0, 12, 11, 3, 12]
    assert [rows[i]["n_dup_lines"] for i in range(6)] == [0, 0, 1, 0, 0, 0]
    assert [rows[i]["n_repeat_words"] for i in range(6)] == [0, 0, 12, 10, 0, 12]
    assert rows[4]["n_symbols"] == 4 and rows[4]["n_shouts"] == 1 and rows[5]["word_chars"] == 12


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(0.0, 500.0), (3.0, 900.0), (40.0, 20000.0)]
    rows = spark.createDataFrame(cases, "k double, n double").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.004).alias("p")).collect()
    for r in rows:
        exact = sum(math.comb(int(r["n"]), i) * 0.004**i * 0.996 ** (r["n"] - i) for i in range(int(r["k"]) + 1))
        assert abs(r["p"] - exact) < 1e-9 * max(exact, 1e-12) + 1e-12 or r["k"] >= r["n"] * 0.004


def test_quality_rules_keep_and_reject(spark):
    good = [f"plain words number {i} stand here in a row of ten and more" for i in range(1600)]
    bad = [f"bad ### ### ### ### ### ### ### ### ### {i}" for i in range(50)]
    d = docs(spark, [*good, *bad, None])
    labels = spark.createDataFrame([(i, int(i < 1600)) for i in range(1650)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(1600))
    assert quality.keep_good(d.limit(0), labels).count() == 0


def test_topk(spark):
    rng = random.Random(3)
    vectors = {i: [rng.gauss(0, 0.2) for _ in range(8)] for i in range(230)}
    vectors |= {i: vectors[7] for i in range(60, 75)}
    extra = [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [0.5, 0.25]), (None, vectors[0])]
    df = topk.usable(spark.createDataFrame([*vectors.items(), *extra], "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    for q in range(0, 230, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_language_id(spark):
    words = {"en": "the quick house river stone", "de": "der schnelle haus fluss stein", "fr": "la rapide maison riviere pierre", "es": "el rapido casa rio piedra"}
    d = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(words.items())], "doc_id long, text string, lang string")
    pages = [(i, f"https://h{i % 3}.example.org/{k}", f"<html lang='{k}'><body><p>{t}</p></body></html>") for i, (k, t) in enumerate(list(words.items()) * 5)]
    pages += [(90, None, None), (91, "https://h0.example.org/x", "")]
    out = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), d).collect()}
    assert len(out) == len(pages) and all(out[i] == list(words)[i % 4] for i in range(20))


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{rng.randint(0, 60)}" for _ in range(30)]
        if bad:
            for _ in range(6):
                words[rng.randrange(30)] = rng.choice(["scum", "moron", "trash"])
        rows.append(" ".join(words))
        labels.append((i, int(bad)))
    d = docs(spark, [*rows, None, ""])
    scored = {r["doc_id"]: r for r in toxicity.score_documents(d, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")).collect()}
    assert len(scored) == 602 and all(0 <= r["score"] <= 1 for r in scored.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i]["held_out"] for i in held)
    assert sum(scored[i]["predicted"] == labels[i][1] for i in held) > 0.95 * len(held)
    none = toxicity.score_documents(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("predicted = 1").count() == 0


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<s>\\\\", "a\n<\\/s>[\\INST]", "", None, "[image#0]", "<<s>"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % 7]) for c in range(3) for t in range(150)] + [(None, None, None, None), (5, 1, "a\nb</s>", "x"), (5, 1, "a\nb</s>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    turns = df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    got = {r["conv_id"]: r for r in chat.digest(chat.read_back(chat.format_turns(turns))).collect()}
    for c in (0, 1, 2, None, 5):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        spelled = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(spelled.encode()).hexdigest() and got[c]["n_turns"] == len(own)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_chat_parts(spark):
    row = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 64), ("document", None, "d.pdf", None), ("text", "[image#1]", None, None)])]
    out = chat.format_turns(spark.createDataFrame(row, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert out["formatted"] == "<s>user\nsee [image#1][document#2][\\image#1]</s>"
    assert [(a["position"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(1, "a.png", 64), (2, "d.pdf", 512)] and out["attachment_tokens"] == 576


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [2048, 7])
def test_covering_links(spark, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)).collect()}
    want = brute_components(fps)
    assert [roots.get(f, f) for f in fps] == [fps[w] for w in want]


def test_masks_cover_every_difference():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    rng = random.Random(6)
    for _ in range(3000):
        apart = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not m & apart for m in masks)


def test_keep_one(spark):
    given = [None, "", "one two three four five six", "one two three four five six", "quite another text with other words in it"]
    kept = simhash.keep_one(docs(spark, given))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]
    twice = docs(spark, given).unionByName(docs(spark, ["some text that stands under a used id"], 2)).unionByName(docs(spark, given))
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [0, 2, 2, 4]
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    good = [f"plain words number {i} stand here in a row of ten and {i} more {i * 7}" for i in range(40)]
    docs(spark, [*good, good[0], None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 40 not in ids and 41 not in ids and ids <= set(range(40))
