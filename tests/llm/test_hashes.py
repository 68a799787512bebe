"""Words and shingles are told apart by their bytes, not by their hashes."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import neardup, packing, shingles


def thue_morse(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [thue_morse(n) for n in (8, 64, 512, 1024, 2048)]


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library_ids(path, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_cancel_in_a_polynomial_have_their_own_ids(tokens):
    texts = [f"{a} {b} {a}" for a, b in PAIRS] + [w for pair in PAIRS for w in pair]
    own = packing.WordTokenizer(tokens)
    for _ in range(2):
        assert [x.tolist() for x in own.many(texts)] == library_ids(tokens, texts)


def test_words_that_share_a_hash_have_their_own_ids(tokens, monkeypatch):
    monkeypatch.setattr(packing, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    texts = ["the and for the was and for", "one two six ten", "it is as we do, so be it"]
    own = packing.WordTokenizer(tokens)
    for _ in range(2):
        assert [x.tolist() for x in own.many(texts)] == library_ids(tokens, texts)


def test_span_hashes_differ_and_dont_depend_on_place():
    words = [w for pair in PAIRS for w in pair] + ["", "a", "b", "ab", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "\0", "\0\0"]
    for lead in ("", "xyz"):
        data = np.frombuffer((lead + "".join(words)).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words]) + len(lead)
        starts = ends - [len(w) for w in words]
        got = shingles.span_hashes(data, starts, ends)
        assert len(set(got.tolist())) == len(words)
        if lead:
            assert (got == before).all()
        before = got


def test_shared_shingles_are_of_equal_words(monkeypatch):
    monkeypatch.setattr(shingles, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    texts = ["a bb ccc dddd eeeee", "a bb ccc dddd fffff", "A BB  CCC\tDDDD ggggg", "z"]
    raw = [t.encode() for t in texts]
    sets = shingles.shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]), 4)
    assert [sets[0].shared(s) for s in sets] == [2, 1, 1, 0] and sets[0].kept().shared(sets[2]) == 1


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_texts_of_cancelling_words_arent_linked(spark, n):
    a, b = thue_morse(n)
    rows = [(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w"), (5, a.upper())]
    got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def brute_roots(texts, width=4, percent=80):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_null_and_repeated_ids_read_each_text_once(spark, monkeypatch, broadcast):
    """Also with texts picked by a shuffle, and with salted bands and classes."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(neardup, "SALT_ROWS", 3)
    monkeypatch.setattr(neardup, "ACROSS_ROWS", 3)
    rng = np.random.default_rng(4)
    texts = []
    for k in range(12):
        base = [f"w{int(x)}" for x in rng.integers(0, 900, 30 + 15 * k)]
        for e in (0, 0, 1, 2, 4, 9):
            copy = list(base)
            for _ in range(e):
                copy[rng.integers(len(copy))] = f"n{rng.integers(1000)}"
            texts.append(" ".join(copy))
    rows = [(None if i % 3 else 7, t, i) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    roots = brute_roots(texts)
    least = {r: min((7 for i, x in enumerate(roots) if x == r and i % 3 == 0), default=None) for r in set(roots)}
    got = neardup.components(df).groupBy("doc_id", "component_id").count().collect()
    want = {}
    for i, r in enumerate(roots):
        key = (None if i % 3 else 7, least[r])
        want[key] = want.get(key, 0) + 2
    assert {(r.doc_id, r.component_id): r["count"] for r in got} == want
    docs = df.select(F.col("doc_id"), "text")
    classes = docs.select(F.lit(1).alias("nid"), F.lit(b"x").alias("ck"), F.struct(F.lit(7).cast("long").alias("id"), F.xxhash64(F.lit(texts[0])).alias("th")).alias("pick")).limit(1)
    assert [r.text for r in neardup._picked_texts(docs, classes, classes.select("nid")).collect()] == [texts[0]]


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_many_words_go_to_the_library_once_each(tokens):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters[:13] for b in letters for c in letters for d in letters][:220_000]
    texts = [" ".join(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    own = packing.WordTokenizer(tokens)
    own.model = Counted(own.model)
    first = [own.many([t])[0] for t in texts]
    assert own.model.calls == len(words)
    assert all((own.many([t])[0] == x).all() for t, x in zip(texts, first))
    assert own.model.calls == len(words)
    assert first[3].tolist() == library_ids(tokens, texts[3:4])[0]


def test_remembered_words_keep_within_their_bytes(tokens, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 40_000)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"wé{'xyz'[i % 3] * int(i % 40)}{'abcdefghij'[i % 10]} the" for i in rng.integers(0, 3000, 400)) for _ in range(30)]
    texts += ["é" * 50_000 + " one long word", " ", "the"]
    want = library_ids(tokens, texts)
    own = packing.WordTokenizer(tokens)
    for _ in range(2):
        for t, ids in zip(texts, want):
            assert own.many([t])[0].tolist() == ids
            assert own.seen.held() <= 40_000
    assert [x.tolist() for x in own.many(texts)] == want


@pytest.mark.parametrize("hashed", [lambda h: h << np.uint64(40), lambda h: h >> np.uint64(60), lambda h: h | np.uint64((1 << 40) - 1)])
def test_words_that_share_slots_have_their_own_ids(tokens, monkeypatch, hashed):
    """Also when they are forgotten in between."""
    monkeypatch.setattr(packing, "span_hashes", lambda data, start, end: hashed(shingles.span_hashes(data, start, end)))
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(60)) + " 1 ?!" for _ in range(20)]
    want = library_ids(tokens, texts)
    for held in (packing.CACHE_BYTES, 30_000):
        monkeypatch.setattr(packing, "CACHE_BYTES", held)
        own = packing.WordTokenizer(tokens)
        for _ in range(2):
            assert [own.many([t])[0].tolist() for t in texts] == want
            assert [x.tolist() for x in own.many(texts)] == want
