from roadlens.llm.queries import RULES
from roadlens.llm.url_filter import judge_urls

KIND = "page_id long, url string, html string, rule int"
LINK = '<html><LINK href="%s" rel=canonical><p>x</p>'


def judged(spark, rows, **more):
    return {x.page_id: tuple(x)[1:5] for x in judge_urls(spark.createDataFrame(rows, KIND), RULES, **more).collect()}


def test_hosts_paths_and_the_longest_rule(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/1?x=://y", "", 0),
        (2, "http://a.example.com/en/1#t", "", 0),
        (3, "http://example.com/EN/", "", 0),
        (4, "x://notexample.com/en/", "", 0),
        (5, "http://a.net/es/7", "", 0),
        (6, "http://net/fr/", "", 0),
        (7, "http://a.net/es", "", 0),
        (8, "nonsense", "", 0),
        (9, None, None, None),
        (10, "http://b.com", "", 0),
        (11, "://?q", "", 0),
        (12, "http://www.example.com?en/", "", 0),
        (13, "http://ÀB.com/é\n/x?y", "", 0),
    ]
    assert judged(spark, rows) == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("a.example.com", "/en/1", "example.com/en/", "block"),
        3: ("example.com", "/EN/", "com/", "allow"),
        4: ("notexample.com", "/en/", "com/", "allow"),
        5: ("a.net", "/es/7", "net/es/", "block"),
        6: ("net", "/fr/", "net/fr/", "block"),
        7: ("a.net", "/es", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("b.com", "", None, "allow"),
        11: ("", "", None, "allow"),
        12: ("www.example.com", "", None, "allow"),
        13: ("Àb.com", "/é\n/x", "com/", "allow"),
    }


def test_decisions_pass_to_aliases_and_allow_comes_first(spark):
    rows = [
        (1, "http://a.net/es/1", LINK % "http://mirror.org/1", 0),
        (2, "https://mirror.org/1/?utm_source=x#top", None, 0),
        (3, "http://third.org/q", '<meta http-equiv="refresh" content="0; url=http://mirror.org/1.html">', 0),
        (4, "http://b.net/fr/2", LINK % "http://both.org/2", 0),
        (5, "http://c.com/2", LINK % "//both.org/2", 0),
        (6, "http://both.org/2", "", 0),
        (7, "http://b.net/fr/2", "", 0),
        (8, "http://own.org/p?b=1&a=2", LINK % "/z", 0),
        (9, "http://own.org/z", "", 0),
    ]
    got = judged(spark, rows)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    assert all(got[k][2] is None for k in (2, 3, 6, 8, 9))
    edges = spark.createDataFrame([("http://own.org/z", "http://x.net/es/9")], "src string, dst string")
    rows.append((10, "http://x.net/es/9", "", 0))
    got = judged(spark, rows, edges=edges)
    assert (got[8][3], got[9][3], got[10][3]) == ("block", "block", "block")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://a.net/es/1", "", 0)] * 3 + [(None, "http://a.net/es/1", "", 0)]
    assert judge_urls(spark.createDataFrame(rows, KIND), RULES).count() == 4
    assert judge_urls(spark.createDataFrame([], KIND), RULES).count() == 0
    assert judged(spark, rows, html_col=None)[1][3] == "block"


def test_edges_from_addresses_alone_change_verdicts(spark):
    rows = [
        (1, "https://m.a.net/es/?utm_source=feed", None, 0),  # its path has the rule's slash
        (2, "http://a.net/es#top", None, 0),  # these have not, but are the same page
        (3, "http://www.a.net/es.html", None, 0),
        (4, "http://b.a.net/es", None, 0),
    ]
    got = judged(spark, rows)
    assert {k: (v[2], v[3]) for k, v in got.items()} == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow")}


def test_relative_links_and_lists_of_rel(spark):
    rows = [
        (1, "http://x.org/d/e?q=1", '<link rel="shortlink canonical" href="f">', 0),
        (2, "http://x.org/d/f", '<meta http-equiv=refresh content="0;url=?s=2">', 0),
        (3, "http://x.org/d/f?s=2", '<link rel=canonical href="http://y.net/fr/1">', 0),
        (4, "http://y.net/fr/1", '<link rel=canonical href="#part"><link rel=stylesheet href="http://x.org/other">', 0),
        (5, "http://x.org", '<link rel=canonical href="mailto:a@b.c"><link rel=canonical href="g">', 0),
        (6, "http://x.org/g", '<link rel=canonical href="http://y.net/es/5">', 0),
        (7, "http://y.net/es/5", "", 0),
        (8, "http://x.org/other", "", 0),
    ]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow"}


def test_rules_on_targets_that_no_page_has_dots_and_entities(spark):
    """The same by SQL, on pages whose links have dot segments and entities."""
    import duckdb

    from roadlens.llm.queries import oracle_sql

    rows = [
        (1, "http://v.org/1", LINK % "http://v.net/fr/9", 0),  # blocked, though no row has that address
        (2, "http://w.org/a/b/c", LINK % "../q", 0),
        (3, "http://w.org/a/q", LINK % "http://w.net/es/1", 0),
        (4, "http://z.org/p", LINK % "http://z.org/r?a=1&amp;b=2", 0),
        (5, "http://z.org/r?b=2&a=1", LINK % "http:&#x2F;&#47;y.net/x/./../fr/..//../fr/k", 0),
        (6, "http://u.org/a/", LINK % "/../../s/t/..", 0),
        (7, "http://u.org/s/", LINK % "http://u.net/fr/", 0),
        (8, "http://u.org/n", LINK % "./.", 0),
        (9, "http://u.org/", LINK % "http://example.com/fr/../en/", 0),
        (10, "http://t.org/...", LINK % "http://t.org/..b/.c", 0),
        (11, "http://t.org/..b/.c", LINK % "http://t.net/es/..", 0),
        (12, "http://t.org/long", "<link rel=canonical href=/" + "x/../" * 3000 + "..b/.c>", 0),
        (13, "http://q.org/", LINK % "http://www.example.com/en/1", 0),
        (14, "http://q.org", LINK % "http://v.net/fr/8", 0),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    assert {x[0]: x[4] for x in con.sql(oracle_sql()["op1_url_alias_filter"]).fetchall()} == got
