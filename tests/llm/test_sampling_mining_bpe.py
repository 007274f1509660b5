"""Importance resampling, hard-negative mining and the BPE transducer against brute force and the library."""

import hashlib
import math
import random
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import bpe, negatives, resampling, topk, toxicity

BPE = P.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(9000))
DOCS = "doc_id long, text string, ids string, n_tokens int, rank int"
ODD = [(1, "one two three"), (2, None), (3, ""), (4, LONG), (5, "x" * 30000), (6, "One two, three!"), (6, "One two, three!"), (None, "lost id " * 15), (7, " \t\n "), (8, "<|endoftext|>é　ü🙂  end <|endo"), (9, "ab " * 25), (10, "ab " * 25)]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def coder():
    spec = open(BPE).read()
    return bpe.Encoder(bpe.Merges(spec), bpe.classes(spec)), bpe.Decoder(bpe.Merges(spec))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PARTS = ["a", "the", "ing", "'", "'l", "ll", "'re", " ", "  ", "\n", "\t", "　", "é", "日本", "1", "22", "²", "!", "--", "<|", "<|endoftext|>", "endoftext", "|>", "🙂", "՘", "\x1c", "\x85", "​", "Ġ", "=", "-" * 9, "w" * 700]


def test_encoder_equals_the_library_however_it_is_fed(coder, library):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40)))
        want, out, i = ids_of(library, text), b"", 0
        assert coder[0].feed(text, True) == want
        while i < len(text):
            n = rng.randrange(1, 300 if rng.random() < 0.2 else 9)
            out += coder[0].feed(text[i : i + n])
            i += n
        assert out + coder[0].feed("", True) == want
        assert coder[1].decode(want) == library.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)


def test_long_runs_in_constant_memory(coder, library):
    rng = random.Random(2)
    for text in ("a" * 20000, "ab" * 9000, "".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "=" * 9000 + " " * 9000 + "x", "日本語" * 3000, " " * 90000, "\n" * 9000 + "a"):
        held, out = 0, b""
        for i in range(0, len(text), 500):
            out += coder[0].feed(text[i : i + 500])
            held = max(held, len(coder[0].window.held) + len(coder[0].rest))
        assert out + coder[0].feed("", True) == ids_of(library, text) == coder[0].encode(memoryview(text.encode()))
        assert held < coder[0].window.size + bpe.LONG + 600


def test_every_character_is_of_the_librarys_class(coder, library):
    for start in range(0, 0x20000, 997):
        text = "".join(f"x{chr(c)}1{chr(c)}\n" for c in range(start, start + 40) if not 0xD800 <= c < 0xE000)
        assert coder[0].feed(text, True) == ids_of(library, text)


def test_ids_that_are_no_text(coder, library):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(1, 12))]
        assert coder[1].decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert coder[1].decode(np.array([64, 10**6, 65], "<u4").tobytes()) == "ab"


def test_lookahead_holds_for_any_merge_list():
    """Tokens that end so far before the end are those of every continuation."""
    rng = random.Random(4)
    for _ in range(300):
        tokens, pairs = [b"a", b"b", b"c"], []
        while len(pairs) < rng.randrange(1, 12):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                tokens.append(u + v)
                pairs.append((u, v))
            elif rng.random() < 0.05:
                break
        ranks = {p: i for i, p in enumerate(pairs)}

        def encode(text, ranks=ranks, pairs=pairs):
            parts = [text[i : i + 1] for i in range(len(text))]
            while (found := [ranks[p] for p in zip(parts, parts[1:]) if p in ranks]):
                u, v = pairs[min(found)]
                i = next(i for i in range(len(parts)) if tuple(parts[i : i + 2]) == (u, v))
                parts[i : i + 2] = [u + v]
            return parts

        far = bpe.lookahead(pairs)
        for _ in range(60):
            start = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
            one, two = (encode(start + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))) for _ in range(2))
            sure = lambda parts, start=start: [p for p, end in zip(parts, np.cumsum(list(map(len, parts)))) if end <= len(start) - far]
            assert sure(one) == sure(two)
    assert bpe.lookahead([]) == 0 and bpe.lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3
    for bad in ([["a", "b"], ["ab", "xy"]], [["a", "bc"]]):
        spec = {"model": {"type": "BPE", "vocab": {}, "merges": bad}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": []}
        with pytest.raises(ValueError):
            bpe.Merges(__import__("json").dumps(spec))


def test_documents_there_and_back(spark, library):
    rows = bpe.round_trip_digests(odd(spark), BPE).collect()
    want = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(odd(spark).limit(0), BPE).count() == 0
    kept = bpe.decode_documents(bpe.encode_documents(odd(spark), BPE).withColumn("note", F.lit("n")), BPE)
    assert kept.columns == ["doc_id", "text", "note"] and {r.text for r in kept.collect()} == {t or "" for _, t in ODD}


def words_of(text):
    return resampling.WORD.findall((text.encode() if isinstance(text, str) else text or b"").lower())


def features(text):
    w = words_of(text)
    return [crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_head_and_tail_give_the_same_crcs(monkeypatch):
    rng = random.Random(3)
    voc = list(dict.fromkeys(bytes(rng.choice(b"abcde\xc3\xa9019") for _ in range(rng.randrange(1, 33))) for _ in range(60)))
    texts = [b" ".join(rng.choice(voc) for _ in range(rng.randrange(0, 60))) for _ in range(30)] + [None, b"", b"..", b"x" * 50]
    head = resampling.Head.of(voc[:40], np.array([(rng.randrange(40), rng.randrange(40)) for _ in range(200)]))
    for block, size in ((7, 11), (3, 5), (1 << 17, 1 << 20)):
        monkeypatch.setattr(resampling, "BLOCK", block)
        monkeypatch.setattr(resampling, "SLICE", size)
        found = [(int(of[i]), int(c)) for w, of, known in resampling.blocks(texts) for last, crc in head.crcs(w, of) for i, c in zip(last, crc) if i >= known]
        assert sorted(found) == sorted((i, c) for i, t in enumerate(texts) for c in features(t))


@pytest.mark.parametrize("target", [["one two three", "ab ab", None, LONG[:3000]], []])
def test_resampling_equals_brute_force(spark, target):
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, " ".join(f"v{(i * j) % 17}" for j in range(i)), "x", 1, 2) for i in range(60)], DOCS))
    rows = docs.select("doc_id", "text").collect()
    s, t = np.zeros(100, int), np.zeros(100, int)
    for counts, texts in ((s, [r.text for r in rows]), (t, target)):
        for text in texts:
            np.add.at(counts, np.array(features(text), int) % 100, 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 100) / ((a + 1) * (t.sum() + 100)))) for a, b in zip(s.tolist(), t.tolist())]
    want = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain[c % 100] for c in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(words_of(text)), len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    asked = sorted((r for r in want if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(asked[: 30 * len(asked) // 100]):
        r[5] = rank + 1
    found = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=30, buckets=100).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str)


def test_resampling_of_nothing_and_ranks_of_ties(spark):
    assert resampling.resample(odd(spark).limit(0), odd(spark)).count() == 0
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("doc_id"), (F.col("id") % 2).alias("score"))
    ranked = resampling.first_ranks(rows, [F.desc("score"), F.asc("doc_id")], 300, 500).collect()
    want = sorted((-r["score"], r["doc_id"]) for r in rows.collect())
    assert sorted((r["rank"], -r["score"], r["doc_id"]) for r in ranked if r["rank"]) == [(i + 1, *w) for i, w in enumerate(want[:300])]
    assert len(ranked) == 500


def test_scores_from_residues_are_exact():
    rng = np.random.default_rng(1)
    for top, dims in ((256, 64), (10**6, 64), (2**40, 100), (2**62, 7), (5, 1), (300, 513)):
        a, b = rng.integers(-top, top + 1, (9, dims)), rng.integers(-top, top + 1, (12, dims))
        a[0], b[0] = top, -top
        found = negatives.Scores(a, dims * negatives.largest(a) * negatives.largest(b)).of(b)
        assert found.tolist() == [[negatives.wrapped(sum(int(x) * int(y) for x, y in zip(p, q))) for q in a] for p in b]


def brute_negatives(rows, k, percent):
    good = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in sorted(good):
        if i % 10 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), j, other) for j, other, w in good if len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:k]:
            for rank, (t, n, _) in enumerate([x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:k]):
                out.append((i, j, rank + 1, n, -s, -t))
    return sorted(out)


@pytest.mark.parametrize("sent", [8, 0])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sent):
    """Broadcast and dealt out; ties, repeated rows and ids, large components, vectors of other lengths, unusable rows."""
    monkeypatch.setattr(negatives, "SENT", sent)
    monkeypatch.setattr(negatives, "ROWS", 16)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(4)]) for i in range(80)]
    rows += rows[:25] + [(10, 0, [1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4), (200, None, [1.0] * 4), (210, 1, None), (220, 1, []), (230, 1, [1.0, None, 1.0, 1.0]), (240, 1, [float("nan")] * 4), (250, 1, [float("inf")] * 4)]
    rows += [(300 + i, i % 2, [1.0 + i, 2.0]) for i in range(12)] + [(400 + i, i % 2, [1e6 * (i + 1), 3.0]) for i in range(12)] + [(500, 7, [1.0])]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("row", F.lit("x"))
    found = negatives.hard_negatives(given, F.col("vec_id") % 10 == 0, 3, 3, 80)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 3, 80)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    given = spark.createDataFrame([(10, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    for rows in (given, given.limit(0)):
        assert negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("far", [1, 5])
def test_large_rows_stay_out_of_the_approximations(spark, monkeypatch, far):
    """Some rows a thousand times as long as the others, one of them a query: few candidates, exact results."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[17, 100, 900, 901, 902][:far]] = rng.standard_normal((far, 32)) * 1000
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    given, kept, real = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), [], topk.candidates
    monkeypatch.setattr(topk, "candidates", lambda *a: kept.append(real(*a)) or kept[-1])
    found = topk.top_k(given, F.col("vec_id") % 100 == 0, 10).toPandas()
    assert kept[0].count() < 0.01 * 60 * 6000
    ints = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 6000, 100):
        score = ints @ ints[q]
        want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id)] == want


def insult_corpus(insults, per_document, documents, rng):
    """(texts, labels, maker) of ``documents`` toxic texts of random words, each with some of the insults, and as many clean ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(3000)]

    def make(words):
        text = rng.choices(vocabulary, k=rng.randint(30, 90))
        for w in words:
            text.insert(rng.randrange(len(text)), w)
        return " ".join(w + "." * (k % 9 == 8) for k, w in enumerate(text))

    texts = [make(rng.sample(insults, per_document)) for _ in range(documents)] + [make([]) for _ in range(documents)]
    order = rng.sample(range(2 * documents), 2 * documents)
    return [texts[k] for k in order], np.array([int(k < documents) for k in order]), make


@pytest.mark.parametrize("many, per_document", [(60, 1), (120, 1), (240, 4)])
def test_many_insults_leave_clean_documents_alone(many, per_document):
    rng = random.Random(many)
    insults = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(many)]
    texts, y, make = insult_corpus(insults, per_document, 2400, rng)
    model = toxicity.Model(texts, y)
    assert (model([make([]) for _ in range(400)]) >= 0.3).mean() <= 0.05
    assert (model([make(rng.sample(insults, per_document)) for _ in range(400)]) >= 0.3).mean() >= 0.95


@pytest.mark.parametrize("documents", [pytest.param(300, marks=pytest.mark.xfail(reason="it is a landmark, but recall was 0.85 and 4.5 % of clean documents were flagged")), 1000, 2400])
def test_a_rare_insult_needs_as_many_documents_in_any_sample(documents):
    rng = random.Random(3)
    texts, y, make = insult_corpus(["plomkin"], 1, documents, rng)
    for k in np.flatnonzero(y)[:12]:
        texts[k] = make(["zqvrtul"])
    model = toxicity.Model(texts, y)
    assert b"zqvrtul" in model.landmarks.marks
    assert (model([make(["zqvrtul"]) for _ in range(200)]) >= 0.3).mean() >= 0.95 and (model([make([]) for _ in range(400)]) >= 0.3).mean() <= 0.02


def test_nothing_learnt_scores_nothing():
    assert toxicity.choose([{b"a"}, {b"b"}], [{b"c"}]) == ([], [])
    model = toxicity.Model(["a b", "c d", "e f", "g h"], np.array([0, 1, 0, 1]))
    assert model.landmarks is None and model(["a b", "c d", None, ""]).tolist() == [0, 0, 0, 0]
