from auditlake.llm.urlgraph import Propagation, Rule, judged_urls, propagate

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def page(i, url, *links):
    return i, url, "".join(f'<a href="{x}">x</a>' for x in links), None


def test_rules_hosts_and_links(spark):
    rows = [
        page(1, "http://A.Net/x"), page(2, "https://b.EXAMPLE.net/en/1?x#y"), page(3, "ftp://example.com/de/"),
        page(4, "http://example.com/en/"), page(5, "http://notexample.com/de/"), page(6, "http://x.org/fr/a://b/c"),
        page(7, "http://a.net"), page(8, None), page(9, "no scheme/net/"), page(10, "http://?q"), page(11, "http://é.net#f"),
        # All links of this host go to blocked hosts, and all links to a.net come from it.
        page(12, "http://farm.example.edu/", "http://A.net/1", "//a.net/2", "https://a.net/3", "/local"),
        page(13, "http://farm.example.edu/2", "http://a.net/"),
        page(14, "http://fine.example.edu/", "http://x.org/fr/"), (15, "http://quiet.edu/", None, None), (None, "http://a.net/", "", None),
        page(1, "http://A.Net/x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [tuple(r) for r in judged_urls(pages, RULES).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == ("a.net", "/x", "net/", "block")
    assert by_id[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert by_id[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert by_id[5] == ("notexample.com", "/de/", None, "allow")
    assert by_id[6] == ("x.org", "/fr/a://b/c", "org/fr/", "allow")
    assert by_id[7] == ("a.net", "", None, "block")
    for k in (8, 9):
        assert by_id[k] == ("", "", None, "allow")
    assert by_id[10] == ("", "", None, "allow")
    assert by_id[11] == ("é.net", "", None, "allow")
    assert by_id[12][2:] == by_id[13][2:] == (None, "block")
    assert by_id[14][2:] == by_id[15][2:] == (None, "allow")
    assert by_id[None] == ("a.net", "/", "net/", "block")
    assert judged_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in judged_urls(pages, []).collect()} == {"allow"}


def test_propagation_equals_direct_sums(spark):
    links = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 5), ("d", "c", 1)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.5), "d": (0.0, 1.0)}
    how = Propagation(rounds=4)
    hosts = "abcd"
    start = {h: [0.15 * x for x in seeds.get(h, (0, 0))] for h in hosts}
    now = start
    for _ in range(how.rounds):
        new = {h: list(v) for h, v in start.items()}
        for s, d, n in links:
            new[d][0] += 0.85 * now[s][0] * n / sum(m for x, _, m in links if x == s)
            new[s][1] += 0.85 * now[d][1] * n / sum(m for _, x, m in links if x == d)
        now = new
    frames = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trusted double, blocked double"), spark.createDataFrame(links, "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in propagate(*frames, how).collect()}
    for h in hosts:
        assert abs(got.get(h, (0, 0))[0] - now[h][0]) < 1e-9 and abs(got.get(h, (0, 0))[1] - now[h][1]) < 1e-9
