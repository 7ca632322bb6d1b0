import random

from roadlens.llm.bpe import Encoder, default_vocabulary
from roadlens.llm.edit_counts import CountTree, cleaning_edits, edited_counts

PARTS = [" ", "  ", "\n", "a", "bc", "12", "'", "l", "'ll", "é", "!!", " the", "\t", "x1"]


def text(r, n):
    return "".join(r.choice(PARTS) for _ in range(n))


def test_every_edit_equals_a_fresh_count():
    r, e = random.Random(11), Encoder(default_vocabulary(), special=False)
    for _ in range(300):
        now = text(r, r.randrange(0, 40))
        tree = CountTree(now, e)
        for _ in range(8):
            a = r.randrange(0, len(now) + 2)
            b, new = a + r.randrange(0, 6), text(r, r.randrange(0, 4))
            tree.edit(a, b, new)
            now = now[:a] + new + now[max(a, min(b, len(now))) :] if a <= len(now) else now + new
            assert tree.current() == now
            assert tree.tokens == len(e.encode([now])[0]), repr(now)
            assert tree.length == len(now)


def test_long_text_encodes_little():
    e = Encoder(default_vocabulary(), special=False)
    t = "the quick brown fox " * 5000
    tree = CountTree(t, e)
    tree.edit(50_000, 50_003, "lazy dog")
    assert tree.encoded_chars < 60
    assert tree.tokens == len(e.encode([t[:50_000] + "lazy dog" + t[50_003:]])[0])


def test_in_spark(spark):
    kind = "doc_id long, text string, n_tokens string, edits array<struct<start:int,stop:int,text:string>>"
    rows = [
        (1, "one two three", "x", [(4, 7, "2"), (5, 6, "overlaps"), (99, 120, "!")]),
        (2, None, "x", [(0, 0, "new")]),
        (3, "same", "x", None),
        (None, "", "x", []),
        (5, "ab cd", "x", [(None, 3, "z"), (3, 1, "z"), (0, 2, None)]),
    ]
    e = Encoder(default_vocabulary(), special=False)
    n = lambda s: len(e.encode([s])[0])
    got = {x.doc_id: tuple(x)[1:6] for x in edited_counts(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        1: (13, n("one two three"), 2, 12, n("one 2 three!")),
        2: (0, 0, 1, 3, n("new")),
        3: (4, n("same"), 0, 4, n("same")),
        None: (0, 0, 0, 0, 0),
        5: (5, n("ab cd"), 1, 3, n(" cd")),
    }
    docs = spark.createDataFrame([(1, "a b\nmail x@y.z now\na b\n\n\nend\na b"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: tuple(x)[2:6] for x in edited_counts(cleaning_edits(docs)).collect()}
    want = "a b\nmail <MAIL> now\n\n\nend"
    assert got[1] == (n("a b\nmail x@y.z now\na b\n\n\nend\na b"), 3, len(want), n(want))
    assert got[2] == (0, 0, 0, 0)
    assert edited_counts(cleaning_edits(docs.limit(0))).count() == 0


def test_stored_trees_take_a_second_batch_of_edits(spark):
    import numpy as np

    from roadlens.llm import edit_counts as ec
    from roadlens.llm.bpe import Encoder, default_vocabulary

    for a in ([], [0, 1, 254], [255, 0, 256, 510, 3], [5000]):
        assert ec._wide(ec._narrow(np.array(a))).tolist() == a
    text = "The cats' 12 hats, " * 40 + "x" * 700 + " end"
    one = [(4, 8, "dogs"), (300, 320, "")]
    kind = "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>"
    df = spark.createDataFrame([(1, text, one), (2, "no edits here", None), (1, text, one), (3, None, [(0, 0, "new text")])], kind)
    first = ec.apply_edits(ec.stored_trees(df)).collect()
    e = Encoder(default_vocabulary(), special=False)
    after = text[:4] + "dogs" + text[8:300] + text[320:]
    rows = [x for x in first if x.id == 1]
    assert len(rows) == 2 and all(x.text == after and x.n_tokens_after == int(e.pretokens(after)[1].sum()) and 0 < x.n_chars_encoded < 80 for x in rows)
    assert [(x.text, x.n_tokens_after) for x in first if x.id == 3] == [("new text", int(e.pretokens("new text")[1].sum()))]
    x = rows[0]
    again = spark.createDataFrame([(1, [(10, 12, "34 and"), (700, 701, "! ")], x.text, x.n_chars_after, x.n_tokens_after, x.lens, x.toks)], "id long, edits array<struct<start:int,stop:int,text:string>>, text string, n_chars long, n_tokens long, lens binary, toks binary")
    y = ec.apply_edits(again).first()
    want = after[:10] + "34 and" + after[12:700] + "! " + after[701:]
    assert y.text == want and (y.n_tokens_after, y.n_chars_after) == (int(e.pretokens(want)[1].sum()), len(want))


def test_the_query_against_encoding_anew(spark, sf_dir):
    from roadlens.llm.bpe import Encoder, default_vocabulary
    from roadlens.llm.edit_counts import cleaning_edits
    from roadlens.llm.queries import op6_edit_aware_counts

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    e = Encoder(default_vocabulary(), special=False)
    want = {}
    for x in cleaning_edits(docs).collect():
        new, at = [], 0
        for d in x.edits:
            new += [x.text[at : d.start], d.text]
            at = d.stop
        new = "".join(new) + (x.text or "")[at:]
        count = lambda t: int(e.pretokens(t)[1].sum())
        want[x.doc_id] = (len(x.text), count(x.text), len(x.edits), len(new), count(new))
    got = op6_edit_aware_counts(spark, sf_dir).collect()
    assert {x.doc_id: (x.n_chars, x.n_tokens, x.n_edits, x.n_chars_after, x.n_tokens_after) for x in got} == want
    edited = [x for x in got if x.n_edits]
    assert edited and sum(x.n_chars_encoded for x in edited) < 0.5 * sum(x.n_chars for x in edited)
