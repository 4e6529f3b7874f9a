from claimloom.llm import url_filter as uf
from claimloom.llm._shared import table
from tests.oracle import compare


def verdicts(spark, urls):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return {urls[r["page_id"]]: r for r in uf.url_verdicts(df).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme.net/": ("", "", None, "allow"),
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "http://example.net": ("example.net", "", None, "allow"),
        "x://myexample.com/de/": ("myexample.com", "/de/", None, "allow"), "x://b.example.com/de/a#b": ("b.example.com", "/de/a", "example.com/de/", "block"),
        "http://org/fr/#": ("org", "/fr/", "org/fr/", "allow"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"), "http://net:80/": ("net:80", "/", None, "allow"),
        "http://É.org/fr/": ("É.org", "/fr/", "org/fr/", "allow"), "\nhttp://x.net/\n": ("x.net", "/\n", "net/", "block"),
    }
    got = verdicts(spark, list(cases))
    assert {u: (r["host"], r["path"], r["rule"], r["verdict"]) for u, r in got.items()} == cases


def test_vocabulary_counts_distinct_bounded_terms(spark):
    cases = {
        "http://a.example/spam": (1, 0, "block"), "http://spammer.example/": (0, 0, "allow"), "http://a.example/SPAM-spam": (1, 0, "block"),
        "http://a.example/free/free": (0, 1, "allow"), "http://a.example/free-bonus": (0, 2, "block"), "http://a.org/fr/spam": (1, 0, "allow"),
        "http://hotel.example/freedom": (0, 0, "allow"), "http://a.example/porno": (1, 0, "block"), "spam free win": (1, 2, "block"),
    }
    got = verdicts(spark, list(cases))
    assert {u: (r["n_strict"], r["n_soft"], r["verdict"]) for u, r in got.items()} == cases


def test_long_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://x.example/" + "a" * 200000 + "/spam")] * 2, "page_id long, url string")
    assert [r["verdict"] for r in uf.url_verdicts(df).collect()] == ["block", "block"]
    assert uf.url_verdicts(df.limit(0)).count() == 0


def test_query(spark, sf):
    assert compare(spark, sf, lambda s, d: uf.url_verdicts(table(s, d, "pages")), uf.oracle()) is None


def test_weights_and_a_vocabulary_from_a_file(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("Alpha 3\nbeta\t1\n\ngamma 2\n")
    terms = uf.read_terms(spark, f"file://{path}")
    assert terms == {"alpha": 3, "beta": 1, "gamma": 2}
    df = spark.createDataFrame([(1, "http://a.org/beta"), (2, "http://a.org/beta-gamma"), (3, "http://ALPHA.org/")], "page_id long, url string")
    got = {r["page_id"]: (r["n_strict"], r["n_soft"], r["verdict"]) for r in uf.url_verdicts(df, terms=terms, limit=3).collect()}
    assert got == {1: (0, 1, "allow"), 2: (0, 2, "block"), 3: (1, 0, "block")}
    assert {r["verdict"] for r in uf.url_verdicts(df, terms={}).collect()} == {"allow"}
