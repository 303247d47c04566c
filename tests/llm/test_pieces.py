"""Streaming Viterbi against a search over the whole text, the library, and exact round trips."""

import random

import numpy as np
import pytest

from docketry.llm import pieces as V

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a  b ", "\n\t x", "a" * 700, "ab" * 400, "日本語 テキスト", "🙂🙂", "é́", "<s></s><unk><0x41>", "1,234.5",
       "don't", "x" * 30 + " " * 40 + "y", "\x00\x7f", "�", "a b"]


def texts(n=150, seed=1):
    rng = random.Random(seed)
    alphabet = "aabcdeeeinorstth  .,ÄéñßоΩ日\n"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(n)]


def whole(text, v):
    """Best path by a table over the whole text (unigram scores)."""
    best = [(0.0, 0, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        found = [(best[b][0] + v.scores[v.ids[text[b:end]]], b, v.ids[text[b:end]])
                 for b in range(max(0, end - v.longest), end) if text[b:end] in v.ids]
        best[end] = max(found, key=lambda x: (x[0], -x[1]), default=(best[end - 1][0] - 1e6, end - 1, V.UNKNOWN))
    out, at = [], len(text)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def test_unigram_paths_are_best():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 6))) for _ in range(90)} | set("ab▁"))
    v = V.Vocabulary(["<unk>", *words], [0.0, *(-rng.random() * len(w) ** .5 * 3 for w in words)], {}, 0, kind="unigram")
    for _ in range(200):
        text = "".join(rng.choice("aabbc▁d") for _ in range(rng.randrange(0, 400)))
        got = list(V.stream(iter(text), v))
        assert "".join(t for _, t in got) == text
        assert [n for n, _ in got] == whole(text, v)


def test_ids_are_committed_within_a_window():
    v = V.Vocabulary.load(MODEL)
    read = 0

    def counted():
        nonlocal read
        for c in "internationalization" * 400:
            read += 1
            yield c

    done, most = 0, 0
    for _, part in V.stream(counted(), v):
        done += len(part)
        most = max(most, read - done)
    assert done == 8000 and most <= 16 * v.longest


def test_bpe_ids_are_the_library_s_and_decode_back():
    own, library = V.Codec(V.Vocabulary.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts():
        for _ in range(2):
            ids = np.frombuffer(own.encode(text), "<u4")
            assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text


def test_columns(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(texts(40))] + [(900, None, "y", 1), (900, None, "y", 1), (None, "a", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_from string, n int").repartition(3)
    both = V.decode(V.encode(docs, MODEL), MODEL)
    got = both.collect()
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") for r in got)
    told = V.digests(both).where("text is null").first()
    assert told.n_ids == 0 and told.ids_crc32 == 0
    assert V.decode(V.encode(docs.limit(0), MODEL), MODEL).collect() == []


def test_neighbours_are_apart_as_merging_leaves_them():
    v, rng = V.Vocabulary.load(MODEL), random.Random(8)
    numbers = list(v.ids.values())
    alike = [i for i in numbers if len(set(v.pieces[i])) <= 2 and len(v.pieces[i]) > 1]
    for n in range(20_000):
        a, b = (rng.choice(alike if n % 2 else numbers) for _ in range(2))
        assert v.apart(a, b) == (v.merged(v.pieces[a] + v.pieces[b])[-1] == [v.pieces[a], v.pieces[b]])
