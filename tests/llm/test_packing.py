import random

import pytest

from roadlens.llm.packing import best_fit, pack, word_lengths


def plain_best_fit(lengths, caps, overhead, reach):
    """The same rule with plain lists."""
    bins = []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for at, i in enumerate(order):
        n = lengths[i]
        open_ = [(c - sum(lengths[j] for j in has), k) for k, (c, has) in enumerate(bins) if c - sum(lengths[j] for j in has) >= n]
        if open_:
            bins[min(open_)[1]][1].append(i)
            continue

        def price(c):
            full = n
            for j in order[at + 1 :]:
                if full + lengths[j] <= c:
                    full += lengths[j]
            small = min(x for x in caps if x >= full)
            return (overhead + small + small * small / reach) / full

        bins.append((min((c for c in sorted(caps) if c >= n), key=price), [i]))
    return [has for _, has in bins]


def test_equals_plain_lists_and_shrinks():
    r = random.Random(2)
    for _ in range(80):
        caps = sorted(r.sample(range(5, 60), r.randrange(1, 4)))
        lengths = [r.randrange(1, caps[-1] + 1) for _ in range(r.randrange(0, 50))]
        reach = r.choice([20.0, 100.0, float("inf")])
        bins, offsets, fill, final = pack(lengths, caps, 2.0, reach)
        want = plain_best_fit(lengths, caps, 2.0, reach)
        assert [[i for i in has] for has in want] == [sorted((i for i, b in enumerate(bins) if b == k), key=lambda i: offsets[i]) for k in range(len(want))]
        for k, has in enumerate(want):
            assert fill[k] == sum(lengths[i] for i in has)
            assert final[k] == min(c for c in caps if c >= fill[k])


def test_the_choice_of_sizes():
    assert pack([3], [8, 64], 0.0)[3] == {0: 8}
    # a long bin takes all three, two short ones waste less
    assert sorted(pack([60, 30, 30], [32, 64], 16.0)[3].values()) == [64, 64]
    # pieces that fill short bins as well go there once attention counts
    assert set(pack([32] * 8, [32, 64], 0.0, 100.0)[3].values()) == {32}
    assert set(pack([32] * 8, [32, 64], 16.0)[3].values()) == {64}
    # pieces that would leave half of a short bin empty open a long one
    assert set(pack([17] * 15, [32, 256], 0.0, 1000.0)[3].values()) == {256}


def test_several_sizes_beat_each_single_one():
    import numpy as np

    lengths = [int(x) for x in np.clip(np.random.default_rng(3).lognormal(5.5, 1.2, 4000), 1, 8192)]
    caps = (512, 1024, 2048, 4096, 8192)
    cost = lambda c: 16 + c + c * c / 32768

    def total(result):
        return sum(result[3].values()), sum(cost(c) for c in result[3].values())

    opened = pack(lengths, caps, 16.0, 32768.0)
    assert len(set(opened[3].values())) >= 4
    room, spent = total(opened)
    assert sum(lengths) / room > 0.97
    _, alone = total(pack(lengths, (8192,), 16.0, 32768.0))
    shrunk = pack(lengths, (8192,), 16.0, 32768.0)[2]
    assert spent < alone and spent < sum(cost(min(c for c in caps if c >= x)) for x in shrunk)


def test_in_spark_every_token_has_one_place(spark):
    rows = [(i, i % 97 * 3) for i in range(500)] + [(1000, 5000), (1000, 5000), (1001, None), (1002, -4), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    caps = (64, 128, 512)
    out = best_fit(df, caps, shard_rows=150).collect()
    assert len({x.shard for x in out}) > 2
    total = sum(max(n or 0, 0) for _, n in rows)
    assert sum(x.length for x in out) == total
    bins = {}
    for x in out:
        if x.length:
            bins.setdefault((x.shard, x.bin), []).append(x)
        else:
            assert x.bin is None
    for has in bins.values():
        has.sort(key=lambda x: x.bin_offset)
        at = 0
        for x in has:
            assert x.bin_offset == at
            at += x.length
        assert at == has[0].bin_length <= has[0].capacity == min(c for c in caps if c >= at)
    long = sorted((x.piece, x.start, x.length) for x in out if x.doc_id == 1000)
    assert long == sorted([(k, k * 512, 512 if k < 9 else 392) for k in range(10)] * 2)
    used = sum(v[0].capacity for v in bins.values())
    assert total / used > 0.9


def test_lengths_and_bad_input(spark):
    docs = spark.createDataFrame([(1, "a b\tc\xa0d", "x"), (2, None, "y")], "doc_id long, text string, length string")
    assert {tuple(x) for x in word_lengths(docs).collect()} == {(1, 4), (2, 1)}
    assert best_fit(word_lengths(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        best_fit(word_lengths(docs), capacities=(0, 5))


def test_the_query_against_plain_lists(spark, sf_dir):
    from roadlens.llm.queries import op5_variable_best_fit

    caps = (512, 1024, 2048, 4096, 8192)
    want = {}
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want[x.doc_id] = len((x.text or "").split()) + 1
    got = sorted(op5_variable_best_fit(spark, sf_dir).collect(), key=lambda x: (x.doc_id, x.piece))
    sums, bins = {}, {}
    for i, x in enumerate(got):
        assert x.start == sums.get(x.doc_id, 0) and x.shard == 0
        sums[x.doc_id] = x.start + x.length
        bins.setdefault(x.bin, []).append(i)
    assert sums == want
    plain = plain_best_fit([x.length for x in got], caps, 16.0, 32768.0)
    assert sorted(map(sorted, plain)) == sorted(bins.values())
    assert all(got[i].capacity == min(c for c in caps if c >= sum(got[j].length for j in has)) for has in bins.values() for i in has)


def test_shards_don_t_depend_on_how_rows_lie_in_files(spark):
    rows = [(i % 400 if i % 7 else None, i % 90) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    packed = lambda d: sorted((tuple(x) for x in best_fit(d, (64, 128), shard_rows=300).collect()), key=repr)
    assert packed(df) == packed(df.repartition(13, "length")) == packed(df.orderBy("length").coalesce(1))
