import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from roadlens.llm.queries import op12_byte_index_simhash
from roadlens.llm.simhash_dedup import _column_sums, _covering, fingerprint_links, fingerprints, near_fingerprints

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    k = min(width, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, most=2):
    """rows: (id, text). (id, hex, component) of each, by plain loops over all pairs."""
    prints = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    ids = {c: [rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None] for c in set(label)}
    return sorted(((i, f"{p:016x}", min(ids[c], default=None)) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=repr)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_the_query_equals_brute_force(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in op12_byte_index_simhash(spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_bits_are_summed_exactly():
    for n in (1, 254, 255, 256, 1000, 4096):
        h = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        assert (_column_sums(bits) == bits.sum(0)).all()


@pytest.mark.parametrize("most", [1, 2, 3])
def test_any_shared_positions_contain_a_list(most):
    lists = _covering(8 - most)
    for same in combinations(range(8), 8 - most):
        assert any(set(c) <= set(same) for c in lists)


@pytest.mark.parametrize("compared", [1, 3, 48])
@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_of_alike_fingerprints_lose_none(spark, most, compared):
    r = random.Random(most * 100 + compared)
    centres = [0, (1 << 64) - 1, 1 << 63, *[r.getrandbits(64) for _ in range(3)]]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for b in r.sample(range(64) if r.random() < 0.5 else range(40, 56), r.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = sorted(tuple(x) for x in fingerprint_links(df, most, compared).collect())
    want = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= most)
    assert got == want and len(want) > 20


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d"), (5, "A b C d"), (6, "one"), (7, "one two"), (8, "x y z İÉ q"), (9, long), (10, long + " tail"), (5, "A b C d"), (5, "something else altogether here"), (None, "alone with no id at all"), (12, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, fp int, id int, u int, label int, __text int")
    got = near_fingerprints(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)
    assert near_fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.where("doc_id = 9")).collect()[0].fp
    assert one == signed(plain(long))
    with pytest.raises(ValueError):
        fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 4)
