"""Packing: exact ids, gapless sequences, and how full they are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docketry.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a   b", "x ", "x\t y", "x \n y", "a  b", "a  b", "<|endoftext|> hi <|endoftext|>", "don't it's",
       "🙂 ünï  ", "1234 5 6", "\n\n a", "x" * 3000, "tab\tend \t", "a \x85b", "a\x1c b", "a\x00 b\x00", "\nx", "x\ny,\nz", "w###. (q) a-b! 3rd!! é,,", "é ​ z"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def sample(n=300, seed=2):
    rng = random.Random(seed)
    words = ["the", "ne\nw", "wörd", "!!", "e-mail", "12,5", "(x)", "\ttab", "日本"]
    return ODD + [" ".join(rng.choice(words) for _ in range(int(rng.paretovariate(1) * 20) % 4000)) for _ in range(n)]


def test_remembered_words_give_the_same_ids():
    texts = sample()
    for _ in range(2):
        got = K.encoder(PATH)(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == reference_ids(texts)


def test_pieces_fill_sequences_without_gaps(spark):
    texts = [*sample(), None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "i long, t string").repartition(4)
    got = K.packed_documents(docs, PATH, digest=True).collect()
    want = {i: [*ids, 2] for i, ids in enumerate(reference_ids([t or "" for t in texts]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(want[key]) // 1024) and all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(want[key][r.start:at], "<u4").tobytes())
        assert at == len(want[key])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(len(x) for x in want.values())
    assert len(by_seq) <= -(-total // 1024) + 2


def test_two_for_one_beats_greedy():
    # Greedy fills 10 with 6 + 3; replacing 3 by 2 + 2 closes the gap.
    bins, offsets = K.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.max() == 1 and sorted(bins.tolist()).count(0) == 3
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1024, 3000)
    bins, offsets = K.best_two_fit(lengths, 1024)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 1024 and len(fill) <= lengths.sum() / 1024 * 1.03 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (2, "four"), (None, "five")], "i long, t string")
    rows = K.sequences(K.packed_documents(docs, PATH)).collect()
    assert len(rows) == 1 and len(rows[0].members) == 4 and len(rows[0].ids) == 4 * rows[0].length
    assert K.sequences(K.packed_documents(docs.limit(0), PATH)).collect() == []


def test_words_encoded_together_have_the_ids_of_each():
    import public_tokenizers

    from docketry.llm.packing import Encoder

    words = [" the", " é", " ǅab", " x́y", " कि", "the", " 12ab", " a1", " b's", " ²b", " ªb", " Ɤa", " \U0001e900b", " ", ""]
    words += [f" {a}{b}" for a in "abcxyz" for b in ("tion", "ment", "qq", "é")]
    one = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert one.encode_words(words) == one.encode(words)
    one.TOGETHER = 3
    assert one.encode_words(words) == one.encode(words)
