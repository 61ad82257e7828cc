"""Nulls in every column, repeated rows, long texts, ties, empty tables and clashing names, against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import PIECE, WORD, ids_of

from pointweave.llm import chat, packing, quality, sharding, simhash, spbpe, tokenbin, tokens, topk
from pointweave.llm.common import vocabulary

#: Names that operators use inside or return.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, fp long, kept boolean, score double, bucket int, length long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, -1, 7, 7, None, 0.5, 3, 9) for i, t, lang in rows], CLASHING)


def repeated(long=5000):
    rows = [(1, "one two", "en"), (1, "one two", "en"), (1, "other text", "en"), (None, "lost", None), (None, "lost", None), (None, None, None), (2, None, "de"), (3, "", "xx"), (4, "w" * 40_000, "en"), (5, "a-b " * long, "fr")]
    return rows


def pieces_fit(rows, given):
    """Each text's ids lie in pieces of one doc_id, each id once, and sequences are gapless."""
    want = sorted((-1 if i is None else i, len(ids_of(t))) for i, t, _ in given)
    starts = [r for r in rows if r["start"] == 0]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in starts) == want
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


@pytest.mark.parametrize("packed", ["histogram", "windows"])
def test_packings(spark, packed):
    given = repeated()
    d = clashing(spark, given)
    if packed == "histogram":
        rows = packing.pack_documents(d, vocabulary(WORD)).collect()
    else:
        rows = tokenbin.segment_rows(tokenbin.packed_sequences(d, vocabulary(WORD), window=7000)).collect()
        assert all(r["resets"] for r in rows)
    pieces_fit(rows, given)


def test_packed_matrices_hold_what_the_segments_say(spark):
    texts = ["a b c", "", "x " * 9000, "y z"] * 3
    d = clashing(spark, [(i, t, "en") for i, t in enumerate(texts)]).coalesce(1)
    for r in tokenbin.packed_sequences(d, vocabulary(WORD), pad_id=9).collect():
        ids = memoryview(bytes(r["input_ids"])).cast("I").tolist()
        places = memoryview(bytes(r["position_ids"])).cast("H").tolist()
        cuts = r["cu_seqlens"]
        assert cuts[0] == 0 and len(cuts) == len(r["segments"]) + 1 and ids[cuts[-1] :] == [9] * (4096 - cuts[-1]) and len(ids) == 4096
        assert places == [k for a, b in zip(cuts, cuts[1:]) for k in range(b - a)]
        for a, b, s in zip(cuts, cuts[1:], r["segments"]):
            assert ids[a:b] == ids_of(texts[s["doc_id"]])[s["start"] : s["start"] + s["length"]] and b - a == s["length"]


def test_word_ids_equal_the_library():
    encode = tokens.word_ids(vocabulary(WORD)).encode
    rng = random.Random(8)
    pieces = ["a", "Zé", "ñ", "ß", "İ", "ǅ", "ȷ", "Ω", "漢", "😀", "1", "23", ".", ",", "...", "!?", ")", "'s", "'LL", "-", "_", "×", "÷", "<|endoftext|>", "<|", "é", "\x1c", " ", " ", "  ", "\n", "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        ids = ids_of(text)[:-1]
        assert memoryview(encode(text)).cast("I").tolist() == ids, repr(text)


def test_memo_of_words_is_bounded_and_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    monkeypatch.setattr(tokens, "MEMO_RUNS", 10)
    encoder = tokens.WordIds(vocabulary(WORD))
    words = [f"word{i % 37}x," for i in range(400)]
    assert memoryview(encoder.encode(" ".join(words))).cast("I").tolist() == ids_of(" ".join(words))[:-1]
    assert len(encoder._memo) <= 20 and len(encoder._memo._old) <= 20


def test_sharding(spark):
    given = repeated()
    rows = sharding.shard_documents(clashing(spark, given)).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in given)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE))
    given = repeated()
    digests = []
    for i, t, _ in given:
        ids = [*model.encode(t or ""), model.eos_id()]
        digests.append((-1 if i is None else i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in spbpe.encode_documents(clashing(spark, given), vocabulary(PIECE)).collect()]
    assert sorted(got) == sorted(digests)


def test_decoding_reads_the_ids_alone():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE))
    table = spbpe.prefix_table(vocabulary(PIECE))
    spelled = table.encode("the river house")
    ids = list(map(int, spelled.split()))
    for at in range(len(ids) - 1):
        wrong = [*ids[:at], ids[at] + 7, *ids[at + 1 :]]
        assert table.decode(" ".join(map(str, wrong))) == model.decode(wrong).encode() != table.decode(spelled)
    rng, many = random.Random(2), model.get_piece_size()
    for _ in range(3000):
        some = [rng.choice((rng.randrange(many), rng.randrange(3, 259), 0, 1, 2, ids[0])) for _ in range(rng.randrange(1, 9))]
        assert table.decode(" ".join(map(str, some))) == model.decode(some).encode()


def test_quality_equals_its_sql_where_every_stratum_certifies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "RISK", 0.5)
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = i // 6 % 3 > 0
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(12, 60))]
        if not good:
            words = [w + rng.choice(("###", "!!!!", "")) for w in words] + ["same", "line\nsame", "line\n"] * rng.randrange(3)
        rows.append((i, " ".join(words), ("en", "de", "fr", "es", None, "xx")[i % 6]))
        labels.append((i, int(good)))
    rows += [(0, rows[0][1], "en"), (None, None, None), (901, "", "en"), (902, "word " * 2_000, "de"), (903, "a b c d e f g h i j " * 3, "fr")]
    labels += [(1, 0), (None, 1), (5, None), (7, 1), (7, 1), (5000, 1)]
    d, known = clashing(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    rated = quality.rated_documents(d)
    chosen = quality.cutoffs(rated, known, risk=0.5)
    assert sum(r["symbols"] is not None for r in chosen.collect()) == 5
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.judge(rated, chosen).select(*columns).collect()
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}), tmp_path / "d.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32())}), tmp_path / "l.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    duck.sql(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l.parquet'")
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({quality._sql()})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    kept = [r["kept"] for r in got]
    assert any(kept) and sum(not k for k in kept) > 100


def best_of(rows, k=5):
    asked, out = {}, []
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    whole = lambda v: [math.floor(256 * x) for x in v]
    for i, v in asked.items():
        scores = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(v), whole(w))))), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def vectors(spark, rows):
    extra = [(i, v, i, 1, 2) for i, v in rows]
    return topk.usable(spark.createDataFrame(extra, "vec_id long, embedding array<double>, query_id long, rank int, g int"))


def test_topk_with_repeated_rows(spark):
    rows = [(0, [1.0] * 4)] + [(i, [float(k == (i - 1) % 4) for k in range(4)]) for i in range(1, 9)] * 2
    rows += [(20, [1.0, 1.0, 0.0, 0.0]), (21, [0.0, 0.0, 1.0, 1.0]), (30, [0.49] * 4)]
    df = vectors(spark, rows)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == best_of(rows)


@pytest.mark.parametrize(("n", "size", "scale"), [(500, 9, 1.0), (200, 4, 1e12), (200, 3, 1e18)])
def test_topk_of_random_rows_at_every_magnitude(spark, monkeypatch, n, size, scale):
    monkeypatch.setattr(topk, "GROUP", 150)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = random.Random(n + size)
    rows = [(rng.randrange(n // 2), [round(rng.gauss(0, 1), 1) * scale for _ in range(size)]) for _ in range(n)] + [(7, [scale] * size)] * 60 + [(9, [1.0])]
    df = vectors(spark, rows)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == best_of(rows)


def test_topk_resolves_only_what_the_cutoff_leaves(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(32)]) for i in range(3000)]
    df = vectors(spark, rows)
    asked = df.where("vec_id % 50 = 0")
    left, _ = topk.collected(df, asked)
    assert left.selectExpr("sum(size(rids))").first()[0] < 0.15 * 60 * 3000
    assert sorted(map(tuple, topk.top_k(df, asked).collect())) == best_of(rows)


def fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_fingerprints_equal_the_definition():
    rng = random.Random(12)
    alphabet = ["a", "B", "É", "ß", "\x0b", "\x1c", " ", "word", "Word", " ", "\n", "漢"]
    texts = [None, "", " \n", "one", "one two", "one two three", "one two three four", "A b C d e", "x " * 300, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400))]
    got = simhash.fingerprint_rows([(t or "").encode() for t in texts])
    assert [f"{int(x) & (2**64 - 1):016x}" for x in got] == [fingerprint(t) for t in texts]


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i * i % 7919}" for i in range(250_003))
    assert f"{int(simhash.fingerprint_rows([text.encode()])[0]) & (2**64 - 1):016x}" == fingerprint(text)


def test_simhash_with_repeated_ids(spark):
    rows = [(9, "a b c d e f", "en")] * 200 + [(3, "a b c d e f", "en"), (None, "a b c d e f", None), (None, None, None), (9, "", "en"), (1, "g h i j k l m", "en")]
    found = simhash.near_duplicates(clashing(spark, rows)).collect()
    assert len(found) == len(rows)
    names = {}
    for r in found:
        names.setdefault(r["fp"], set()).add(r["component_id"])
    assert all(len(n) == 1 for n in names.values()) and {3, 9, 1} == {n for own in names.values() for n in own}


def test_chat_of_an_empty_table_and_of_its_own_conversation(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, chunk long, head string"
    rows = [(1, 0, "user", "</s>\\[INST]", 5, "x"), (1, 0, "user", "</s>\\[INST]", 5, "x"), (1, None, None, None, 5, "x"), (None, 3, "assistant", "w" * 100_000, 5, "x"), (2, 1, "assistant", "[image#1]", 5, "x")]
    for own in ([], rows):
        place = tmp_path / str(len(own))
        spark.createDataFrame(own, schema).write.parquet(f"{place}/conversations.parquet")
        out = {r["conv_id"]: r for r in chat.op8_chat(spark, str(place)).collect()}
        said = "</s>[INST] ok [/INST]"
        assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(said) and out[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert len(out) == 1 + len({r[0] for r in own})
        for conv in {r[0] for r in own}:
            turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in own if r[0] == conv))
            assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
            loss = "".join(t for *_, r, t in turns if r == "assistant")
            assert (out[conv]["n_turns"], out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pipeline_stages_on_edge_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = "the quiet river runs past an old stone house near a wide green field"
    rows = [(1, good, "en"), (1, good, "en"), (None, good + " today", None), (None, None, None), (7, "", "xx"), (8, "deep words of another kind about boats and long winter nights at sea", "en")]
    full = clashing(spark, rows)
    for given in (full, full.limit(0)):
        docs, counts = given, []
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            assert docs.columns == before.columns or name == "packing"
            counts.append(docs.count())
        assert counts == ([4, 4, 2, 2] if given is full else [0, 0, 0, 0]), counts
