import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quadrille.llm.bpe import Decoder, Encoder, Transducer, Utf8Stream, detokenize, merge, read_ranks, tokenize

PATH = P.path("byte_bpe_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "\x85", "\xa0", " ", "\x1c", "​", "\U0001f600", "ﬁ", "Ⅷ", "²", "'s", "'ll", "!", "ab", "ing", " the", "́", "日本", "x" * 100]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=600):
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "<|endoftext|>"]


def test_same_ids_as_the_library(ranks, library):
    encoder, decoder = Encoder(ranks, P.PATTERN), Decoder(ranks)
    for text in texts():
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text


def test_states_may_be_dropped_at_any_time(ranks):
    small, large = Transducer(ranks, max_states=3), Transducer(ranks)
    for piece in [b" thhaerti", b"ouonan", b"zzzzzzzz", b" Donaudampf"]:
        assert small.encode(piece) == large.encode(piece)
        if piece not in ranks:
            assert list(large.stream(piece)) == large.encode(piece) == [ranks[t] for t in merge(ranks, piece)]


def test_any_pattern(ranks):
    pattern = r"[a-z]+|\s|[^\sa-z]"
    own, library = Encoder(ranks, pattern, max_chunks=5), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in texts(100):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_texts_and_random_pieces(ranks, library):
    rng, encoder = random.Random(3), Encoder(ranks, P.PATTERN, max_chunks=50)
    for text in ["thhaertiouonan" * 20_000, "-" * 300, "a" * 40_000, " ".join("".join(rng.choices("aehinorstu", k=rng.randint(1, 14))) for _ in range(20_000))]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_are_written_before_the_end(ranks):
    machine, read = Transducer(ranks), []

    def piece():
        for byte in b"thhaertiouonan" * 20:
            read.append(byte)
            yield byte

    next(machine.stream(piece()))
    assert len(read) < 40


def test_ids_that_the_ranks_lack(ranks):
    with pytest.raises(KeyError):
        Decoder(ranks).decode(np.array([99_999], "<u4").tobytes())


def test_utf8_machine_at_every_cut():
    for data in ["aé日\U0001f600z".encode(), b"\xff", b"\xe6\x97", b"\xf0\x9f\x98a", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80x"]:
        for cut in range(len(data) + 1):
            stream = Utf8Stream()
            assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode(errors="replace")


def test_rows(spark, library):
    rows = [(1, "It's 日本", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "It's 日本", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    tokens = tokenize(docs, PATH, P.PATTERN)
    got = sorted(map(tuple, tokens.drop("ids").collect()), key=str)
    want = []
    for key, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted(detokenize(tokens, PATH).collect(), key=str) == sorted([(k, t or "") for k, t, _ in rows], key=str)
    assert tokenize(docs.limit(0), PATH, P.PATTERN).count() == 0
