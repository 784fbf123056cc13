import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(codec, text):
    return [i for block in codec.encode(text) for i in block]


def texts():
    random.seed(4)
    bits = ["a", "aa", " ", "  ", "\n", "é", "ß", "中", "1", "22", "'s", "!!", "the ", "ing", "<|endoftext|>", "<|", "🙂", "\t", "Ġ"]
    return ["".join(random.choice(bits) for _ in range(random.choice([0, 3, 40, 3000]))) for _ in range(60)]


def test_same_ids_as_the_library(codec, library):
    for t in texts():
        assert ids(codec, t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("word", ["a" * 70001, "abcdefgh" * 9000, "".join(random.Random(1).choice("ethaoinrs") for _ in range(30000))])
def test_long_words_stream(codec, library, word):
    assert ids(codec, word) == library.encode(word, add_special_tokens=False).ids


def test_lookahead_holds_for_every_cut(codec):
    r = random.Random(2)
    for _ in range(40):
        data = "".join(r.choice("ethaoinrs dlu") for _ in range(900)).replace(" ", "").encode()
        whole = codec.merged([codec.first[b] for b in data])
        cut = r.randrange(codec.lookahead + 1, len(data))
        part = codec.merged([codec.first[b] for b in data[:cut]])
        at = 0
        for x, y in zip(whole, part):
            if at + len(codec.table[y]) > cut - codec.lookahead:
                break
            assert x == y
            at += len(codec.table[y])


def test_decoder_takes_split_characters(codec):
    d = codec.decoder()
    got = "".join(d.feed([i]) for i in ids(codec, "naïve 🙂 中文")) + d.feed((), True)
    assert got == "naïve 🙂 中文"


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi there", 7), (3, "hi there", 7), (4, "x" * 50000, 8)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_digests(df, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)] == [(0, empty, empty)] * 2
    assert [r.decoded_sha256 for r in got if r.doc_id == 3] == [hashlib.sha256(b"hi there").hexdigest()] * 2
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    assert bpe.encode_ids(df.where("doc_id = 3"), PATH).first().n_tokens == 2
