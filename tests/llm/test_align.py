import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm.align import Aligner, aligned, alignment, byte_ends, default_paths, pair_counts, rated
from roadlens.llm.bpe import byte_symbols
from roadlens.llm.queries import op11_token_alignment

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_paths()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_paths()[1])


def plain(text, tools):
    """(ids of a, ids of b, groups, links) of a whole text by decoded bytes and loops; None where the bytes differ."""
    a, b = tools
    if not text:
        return None
    back = {c: x for x, c in byte_symbols().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, links, i, j, at = [], [], 0, 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        first, second = i, j
        while i < len(ids_a) and ends_a[i] <= cut:
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            j += 1
        groups.append(",".join(map(str, ids_a[first:i])) + "|" + ",".join(map(str, ids_b[second:j])))
        links += [(ids_a[x], ids_b[y]) for x in range(first, i) for y in range(second, j) if (ends_a[x - 1] if x else 0) < ends_b[y] and (ends_b[y - 1] if y else 0) < ends_a[x]]
        at = cut
    assert at == len((" " + text).encode())
    return ids_a, ids_b, groups, links


def brute(rows, tools):
    done = [(i, plain(t, tools)) for i, t in rows]
    count = Counter(p for _, d in done if d for p in set(d[3]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for i, d in done:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = d
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_the_query_equals_brute_force(spark, sf_dir, tools):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_token_alignment(spark, sf_dir)
    assert got.columns == NAMES and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, tools)


PARTS = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", " ", "　", "\x1c", "\x85", ".", ",\"", "');\r", "'s", "12", "é", "日本", "\U0001f600", "\U0001f9d1‍\U0001f680", "Ａ", "á", "ﬁ", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\x00", "​", "﻿", "�", "İ", "ẞ", "௵", "\U00012345", "supercalifragilistic"]


def test_odd_texts_equal_whole_encodings(spark, tools):
    r = random.Random(11)
    texts = [None, "", " ", "  ", "\n", " \n ", "\t", "x▁y", "▁", "a ▁ b", *PARTS]
    texts += ["".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) for _ in range(500)]
    texts += ["".join(r.choice(["ab", " ", "c.", "▁", "\n"]) for _ in range(200)) for _ in range(6)]
    texts += ["é\U0001f600 日 word\n" * 9000, "x" * 20_000, " " * 999]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, pairs int, times int, row int, id int")
    want = brute(rows, tools)
    assert sum(w[1] == 0 for w in want) > 8
    for most in (2_000_000, 5):  # pairs given to tasks, and joined
        got = alignment(df, most=most)
        assert got.columns == NAMES
        assert sorted((tuple(x) for x in got.collect()), key=repr) == want
    assert alignment(df.limit(0)).count() == 0 and alignment(df.limit(0), most=-1).count() == 0
    assert alignment(df.where("text is null or text = ''")).where("n_a + n_b + n_links + count_sum > 0 or groups_sha256 <> ''").count() == 0


def test_units_forgotten_and_met_again(tools):
    """Few units are held, so that they pass to the older ones, come back, and are dropped."""
    r = random.Random(4)
    tool = Aligner(*default_paths(), most=40)
    words = [f"w{i}é" for i in range(90)] + ["x▁"]
    for _ in range(60):
        texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(3)]
        placed, units = tool.place(texts)
        for t, p in zip(texts, placed, strict=True):
            want = plain(t, tools)
            counts = units.counts[p].sum(0)
            assert (counts[5] == len(p)) == (want is not None)
            if want:
                assert counts[:4].tolist() == [len(x) for x in want] and units.text_of(p).decode() == ";".join(want[2]) + ";"
        assert len(tool.now.index) <= 80


def test_spans_are_coarse_cuts_and_bytes_refine_them():
    # "é" as two tokens with one character's span, a token of two characters, an emoji as two empty spans and one full one
    first, last = np.array([0, 0, 1, 3, 3, 3]), np.array([1, 1, 3, 3, 3, 4])
    at = np.array([0, 2, 3, 4, 8])
    assert byte_ends(first, last, np.array([1, 1, 2, 1, 1, 2]), at).tolist() == [1, 2, 4, 5, 6, 8]
    assert byte_ends(first[:0], last[:0], first[:0], at).tolist() == []


def test_counts_by_pair(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog the"), (3, "the"), (3, "the")], "doc_id long, text string")
    held = aligned(docs).cache()
    counts = {x.pair: (x.n, x.best) for x in pair_counts(held).collect()}
    want = Counter(p for x in held.collect() for p in x.pairs)
    assert {p: n for p, (n, _) in counts.items()} == want and max(n for n, _ in counts.values()) == 4
    assert sum(x.n_best for x in rated(held, pair_counts(held)).collect()) == held.select(F.sum("n_links")).collect()[0][0]
