import random

import pytest
from tokenizers import Tokenizer

from roadlens.llm.bpe import Encoder, decode_ids, decoder, default_vocabulary, round_trip

ODD = [" ", "  ", "\n", " \n ", "\t", "\x1c", "\x85", "\xa0", "　", " ", "'s", "'ll", "'LL", "'", "<|endoftext|>", "<|endof", "é", "é", "ß", "漢字", "½", "Ⅷ", "12", "a", "aaaa", "The", " the", "!!", "🙂", "‍", "\x00", "ing", "#*$"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(default_vocabulary())


def texts():
    r = random.Random(5)
    return ["", "a" * 5000, "ab" * 700, "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "word " * 3000, *["".join(r.choice(ODD) for _ in range(r.randrange(1, 40))) for _ in range(1500)]]


def test_ids_and_texts_equal_the_library(theirs):
    e = Encoder(default_vocabulary())
    t = texts()
    ids, counts = e.encode(t)
    back = decoder(e.v)(ids, counts)
    at = 0
    for text, n, b, want in zip(t, counts, back, theirs.encode_batch(t, add_special_tokens=False), strict=True):
        got = ids[at : at + n].tolist()
        at += n
        assert got == want.ids, repr(text)
        assert b == theirs.decode(got, skip_special_tokens=False)


def test_small_cache_gives_the_same(theirs):
    e, t = Encoder(default_vocabulary(), most=50), texts()
    for i in range(0, 200, 7):
        ids, _ = e.encode(t[i : i + 7])
        assert ids.tolist() == [x for y in theirs.encode_batch(t[i : i + 7], add_special_tokens=False) for x in y.ids]


def test_specials_as_ordinary_text(theirs):
    plain = Tokenizer.from_file(default_vocabulary())
    plain.encode_special_tokens = True
    t = ["x <|endoftext|> y", "<|endoftext|>"]
    assert Encoder(default_vocabulary(), special=False).encode(t)[0].tolist() == [x for y in plain.encode_batch(t, add_special_tokens=False) for x in y.ids]


def test_in_spark(spark, theirs):
    rows = [(1, None, 3), (2, "", 4), (None, "null id", 5), (2, "The the", 6), (9, "héllo\n\n wörld " * 4000, 7)]
    got = round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)).collect()
    want = {(i, t or "", tuple(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows}
    assert {(x.doc_id, x.decoded, tuple(x.ids)) for x in got} == want
    ids = spark.createDataFrame([(1, [464, None, 262]), (2, None), (3, [99999, -4])], "doc_id long, ids array<int>")
    assert {tuple(x) for x in decode_ids(ids).collect()} == {(1, "The the"), (2, ""), (3, "")}
    assert round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_against_the_library(spark, sf_dir, theirs):
    import hashlib

    from roadlens.llm.queries import op10_bpe_round_trip

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = theirs.encode(x.text or "", add_special_tokens=False).ids
        want.append((x.doc_id, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op10_bpe_round_trip(spark, sf_dir).collect())) == sorted(want)
