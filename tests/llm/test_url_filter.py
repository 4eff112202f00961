import pytest
from crashgrid.llm.url_filter import collect_vocabulary, filter_pages, judge_urls, read_vocabulary

#        url, host, path, rule, verdict
CASES = [("HTTP://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
         ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
         ("https://example.org/en/27", "example.org", "/en/27", "org/", "allow"),
         ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
         ("http://casino.org/", "casino.org", "/", "org/", "allow"),
         ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
         ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
         ("http://org", "org", "", None, "allow"),
         ("http://x.net?casino", "x.net", "", None, "block"),
         ("http://x.net/casinos", "x.net", "/casinos", None, "allow"),
         ("http://x.net/my_casino", "x.net", "/my_casino", None, "block"),
         ("http://x.net/free", "x.net", "/free", None, "allow"),
         ("http://x.net/cheap/deal", "x.net", "/cheap/deal", None, "allow"),  # two light terms: 60 points of 100
         ("http://x.net/cheap/deal-offer/vip", "x.net", "/cheap/deal-offer/vip", None, "block"),  # four: 120
         ("http://x.net/watch-online_free", "x.net", "/watch-online_free", None, "block"),
         ("http://x.net/free/FREE-free", "x.net", "/free/FREE-free", None, "allow"),
         ("http://free.net/loan", "free.net", "/loan", None, "block"),
         ("mailto:free.loan", "", "", None, "block"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
         ("://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
         ("http://x.net/" + "a/" * 100_000 + "porn", "x.net", "/" + "a/" * 100_000 + "porn", None, "block")]


@pytest.fixture
def pages(spark):
    rows = [(i, c[0], "h", "x", 0) for i, c in enumerate(CASES)]
    return spark.createDataFrame([*rows, (None, CASES[0][0], None, None, None), rows[0]],
                                 "page_id long, url string, host string, verdict string, strict int")


def test_rules_then_vocabulary(pages):
    got = judge_urls(pages).collect()
    assert len(got) == len(CASES) + 2
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert [found[i] for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert found[None] == CASES[0][1:]


def test_vocabulary_is_a_parameter_and_blocked_rows_go(pages):
    kept = filter_pages(pages)
    assert kept.columns == pages.columns
    assert sorted(r["page_id"] for r in kept.collect()) == [i for i, c in enumerate(CASES) if c[4] == "allow"]
    assert judge_urls(pages, vocabulary={}, rules=()).where("verdict = 'block'").count() == 0
    assert judge_urls(pages.limit(0)).count() == 0


def test_weights_decide_and_terms_come_from_files_and_tables(spark, pages, tmp_path):
    urls = spark.createDataFrame([(1, "x alpha beta"), (2, "x alpha gamma"), (3, "delta"), (4, "alphabeta gamma beta")],
                                 "page_id long, url string")
    (tmp_path / "t.tsv").write_text("# note\nalpha\tsoft\t40\nbeta\tsoft\t70\ngamma\tsoft\t30\ndelta\tstrict\t1\n")
    words = read_vocabulary(tmp_path / "t.tsv")
    got = {r["page_id"]: (r["verdict"], r["n_soft"], r["soft_points"]) for r in judge_urls(urls, vocabulary=words).collect()}
    assert got == {1: ("block", 2, 110), 2: ("allow", 2, 70), 3: ("block", 0, 0), 4: ("block", 2, 100)}
    table = spark.createDataFrame([("Alpha", "soft", 40), ("beta", "soft", 70), ("gamma", "soft", 30), ("delta", "strict", 1),
                                   ("beta", "soft", 70)], "term string, class string, points long")
    assert collect_vocabulary(table) == words
    assert {r["verdict"] for r in judge_urls(urls, vocabulary=words, limit=1000).collect()} == {"allow", "block"}
    for bad in ([("", "soft", 1)], [("a", "hard", 1)], [("a", "soft", 1), ("a", "soft", 2)]):
        with pytest.raises(ValueError):
            collect_vocabulary(spark.createDataFrame(bad, "term string, class string, points int"))
    assert len(read_vocabulary()) > 100
