import pytest
from pyspark.sql import functions as F

from roadlens.functions import guards as g
from roadlens.functions import text as tx


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [x[0] for x in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_tokens_split_letters_digits_and_runs_of_han(spark):
    assert one(spark, tx.tokens, "Rainy road, CH4, 对向来车!", "café", "") == [["rainy", "road", "ch4", "对向来车"], ["caf"], []]


def test_normalised_captions(spark):
    cases = {
        "2024-01-02 03:04:05 ch12 rain": "rain",
        "**Lighting:** dim street": "dim street",
        "## Main subjects and background\nA car": "a car",
        "- Overall composition — wide": "wide",
        "1. Mid-ground. trees": "trees",
        "The lighting is low": "the lighting is low",
        "plate ABC1234 and 京A12345 seen": "plate and seen",
        "京津A12345 h264 4k": "京津a12345 4k",
        "main-road junction": "road junction",
        "Environment　：fog": "fog",
        "caféch4 bus": "caféch4 bus",
        "details\r\nred": "details red",
        "details\nred": "red",
    }
    assert dict(zip(cases, one(spark, tx.normalized, *cases), strict=True)) == cases


def test_lexical_text_drops_stopwords_and_repeats(spark):
    assert one(spark, tx.lexical_text, "The red car and the RED bus from this image", "", "对向来车 car 对向来车") == ["red car bus", "", "对向来车 car"]


def test_names_of_folders_and_files(spark):
    assert one(spark, tx.dir_name, "  a/b\\c ", "x\r\n\ty. .", " . ", "", "　雨夜　") == ["a_b_c", "x_y", "empty_query", "empty_query", "雨夜"]
    assert one(spark, tx.stem, "a/b.c.jpg", "/x/.jpg", "b.", "x/y/", "noext") == ["b.c", ".jpg", "b.", "y", "noext"]
    assert one(spark, lambda c: tx.label_of(c, "/r/"), "/r/rain/1.jpg", "/r/1.jpg", "/other/x", "/r/") == ["rain", "1.jpg", None, None]
    assert one(spark, tx.has_cjk, "abc", "雨", "カ", "한", "é") == [False, True, True, True, False]


def test_counts_and_ranks(spark):
    rows = [(99, 10, 10), (99, 50, 50), (3, 1, 1), (3, 150, 3), (10, 5, 1)]
    df = spark.createDataFrame(rows, "n int, p int, want int")
    assert all(x[0] == x[1] for x in df.select(tx.candidate_count(F.col("n"), F.col("p")), "want").collect())
    assert one(spark, lambda c: tx.fallback_rank(c, F.lit(7)), "3", "0", "-2", "x", None) == [3, 7, 7, 7, 7]


def test_expanded_queries(spark):
    raw = ['{"english_queries": [" a ", "A", "b", "", "c"]}', '```json\n{"english_queries": ["x", "y", "z"]}\n```', '{"english_queries": ["x"]}', "nonsense"]
    assert one(spark, lambda c: tx.expanded_queries(c, 2), *raw) == [["a", "b"], ["x", "y"], None, None]


def test_grams(spark):
    assert one(spark, tx.grams, "Été à la plage", "a", "") == [["ete", "la", "plage", "ete la", "la plage"], [], []]


@pytest.mark.parametrize("bad", [(0, 1, 1, 1), (5, 6, 1, 1), (5, 5, True, 1), (5, 5, 1, 1.5), ("5", 5, 1, 1)])
def test_gate_bounds(bad):
    with pytest.raises(ValueError):
        g.gate_bounds(*bad)


def test_other_guards():
    assert g.int_list("10, 20,,30") == [10, 20, 30] and g.int_list([1, 2]) == [1, 2]
    assert g.backend_list("bm25, qwen3vl_embedding_faiss") == list(g.BACKENDS)
    assert g.split_argv(["a", "--", "b", "--", "c"]) == (["a"], ["b", "--", "c"])
    assert g.without_flag(["--x", "1", "--y", "--x=2", "z"], "--x") == ["--y", "z"]
    g.one_image("p", None)
    for f, a in ((g.int_list, ("",)), (g.int_list, ("1,0",)), (g.backend_list, ("faiss",)), (g.query_text, (" ",)), (g.one_image, ("p", "b")), (g.rerank_bounds, (6, 5, 1)), (g.rerank_bounds, (-1, 5, 1)), (g.fixed_gate, (20, 10, 8, 9))):
        with pytest.raises(ValueError):
            f(*a)


def test_accents_and_ligatures(spark):
    import unicodedata

    texts = ["Tiếng Việt ﬁre café", "Ǆ ½ ㎏ Å ẞ İi", "한국어 가", "ｆｕｌｌ ＷＩＤＴＨ", "plain", None, "e\u0301 a\u0323\u0302", "𝐁old 𝔸", "؁ أ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [x.a for x in df.select(tx.without_accents(F.col("t")).alias("a")).collect()]
    plain = lambda s: s and "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert [g and unicodedata.normalize("NFD", g) for g in got] == [p and unicodedata.normalize("NFD", p) for p in map(plain, texts)]
    words = df.where("t like 'Ti%'").select(tx.grams(F.col("t")).alias("g")).first().g
    assert words[:4] == ["tieng", "viet", "fire", "cafe"]


def test_plates_are_those_of_the_pattern(spark):
    """The form for Java, which never goes back in a word, replaces what the plain pattern does; also odd digits, letters that fold to ASCII, and marks."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("aBkKſ09٣京-_é\u0301 \n") for _ in range(r.randint(1, 14))) for _ in range(20_000)] + ["ab" * 40, "京ab1", "京京ab1", "ab1٣", "ab٣1", "1ab", "a1é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, own = (F.regexp_replace("t", tx._UI + p, "<>") for p in (tx.PLATE, tx._PLATE))
    assert df.where(plain != own).count() == 0 and df.where(own != F.col("t")).count() > 1000
