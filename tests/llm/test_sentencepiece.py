import random

import numpy as np
import pytest

from tracegrain.llm import sentencepiece_trie as st

sentencepiece = pytest.importorskip("sentencepiece")
PATH = st.vocabulary_path()
TEXTS = [
    "", " ", "  ", "   a", "a   b  ", "x\n\ty", "é" * 50, "a" * 100, " " * 40, "ﬁ é Ａ 日本語テキスト 🎉🎉", "▁▁ x", "ab" * 200, "\u0000 \x7f", "aAaA " * 20,
    "The quick brown fox, the quick brown foxes; quickly.", "supercalifragilistic" * 300,
]


@pytest.fixture(scope="module")
def vocabulary():
    return st.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice("aabbcc  etionthe\n .,é日🎉") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def pieces_of(codec, texts):
    flat, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    return [flat[e - n : e] for n, e in zip(counts, ends)]


def test_ids_equal_the_library_and_decode_back(vocabulary, library):
    codec = st.Codec(vocabulary)
    texts = TEXTS + random_texts(600)
    for text, ids in zip(texts, pieces_of(codec, texts)):
        assert ids.tolist() == library.encode(text.replace(st.MARK, " ")), text[:50]
        assert codec.decode(ids) == text.replace(st.MARK, " ")


def test_generations_of_remembered_words_change_nothing(vocabulary, monkeypatch):
    texts = random_texts(200)
    want = [x.tolist() for x in pieces_of(st.Codec(vocabulary), texts)]
    monkeypatch.setattr(st, "_CACHE", 20)
    codec = st.Codec(vocabulary)
    assert [pieces_of(codec, [t])[0].tolist() for t in texts] == want


def test_prefixes_are_computed_once(vocabulary):
    words = ["▁inter", "▁international", "▁internationally", "▁internet", "▁zebra"]
    encoder = st.TrieEncoder(vocabulary)
    got = dict(encoder.segment(words))
    trie = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert encoder.steps == len(trie) < sum(map(len, words))
    for w in words:
        assert [encoder.names[p] for p in got[w]] == st.merge(w, vocabulary)


def test_unigram_lattice_equals_trying_all_segmentations():
    rng = random.Random(1)
    pieces = ["<unk>", "▁", *"abc", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = [0.0] + [-rng.uniform(1, 6) for _ in pieces[1:]]
    v = st.Vocabulary(pieces, scores, {0}, None, 0, "unigram")

    def best(word):
        if not word:
            return 0.0
        return max((scores[pieces.index(word[:k])] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces), default=-1e9)

    encoder = st.TrieEncoder(v)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for word, path in encoder.segment(words):
        assert "".join(pieces[i] for i in path) == word
        assert abs(sum(scores[i] for i in path) - best(word)) < 1e-9


def test_documents(spark, library):
    rows = list(enumerate([None, *TEXTS])) + [(1, "again"), (1, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS token_ids")
    got = st.encode_documents(df)
    out = got.collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    assert sorted((str(r.doc_id), r.token_ids) for r in out) == sorted((str(d), library.encode((t or "").replace(st.MARK, " "))) for d, t in rows)
    back = sorted((str(r.doc_id), r.text) for r in st.decode_documents(got).collect())
    assert back == sorted((str(d), (t or "").replace(st.MARK, " ")) for d, t in rows)
    assert st.encode_documents(df.limit(0)).count() == 0
