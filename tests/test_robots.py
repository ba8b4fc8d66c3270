"""Robots rules and the gates of a crawl as decision tables."""

from urllib.robotparser import RobotFileParser

from dossierlake.operators import documents, robots

FILE = """# head
Disallow: /nobody

User-agent: Reader
user-agent: Other
Disallow: /private   # not this
Allow: /private/open
Disallow: /*.pdf$
Disallow: /a*b
Crawl-delay: 3
Allow: /tie
Disallow: /tie

User-agent: *
Disallow: /
"""
HOST = "http://h.example.org"


def rules_of(spark, files):
    return robots.parse_rules(spark.createDataFrame(files, "origin string, content string"))


def allowed(spark, rules, urls, agent="Reader/2.0", first=False):
    got = {r["url"]: r["allowed"] for r in robots.may_read(spark.createDataFrame([(u,) for u in urls], "url string"), rules, agent, first).collect()}
    return [got[u] for u in urls]


def test_rules_are_parsed(spark):
    rules = rules_of(spark, [(HOST, FILE), ("http://empty", ""), ("http://none", None)])
    got = sorted((r["agent"], r["nth"], r["allow"], r["pattern"]) for r in rules.collect())
    assert [g[2:] for g in got if g[0] == "reader"] == [(False, "/private"), (True, "/private/open"), (False, "/*.pdf$"), (False, "/a*b"), (True, "/tie"), (False, "/tie")]
    assert {g[0] for g in got} == {"*", "reader", "other"} and not any(g[3] == "/nobody" for g in got)


def test_longest_pattern_decides(spark):
    rules = rules_of(spark, [(HOST, FILE)])
    table = {
        "/private": False, "/private/x": False, "/private/open/x": True, "/doc.pdf": False, "/doc.pdf?x": True, "/doc.pdfx": True, "/axxb/c": False, "/ab": False, "/xab": True, "/tie": True, "": True, "/": True, "/nobody": True, "?q=1": True, "/private#x": False,
    }
    assert allowed(spark, rules, [HOST + p for p in table]) == list(table.values())
    assert allowed(spark, rules, [HOST + "/x", HOST.upper() + "/x", "http://else/private", "no address"], "Stranger") == [False, False, True, True]


def test_first_match_is_the_older_reading(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nAllow: /\n\nUser-agent: reader\nAllow: /x/y\nDisallow: /x\n"
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    rules = rules_of(spark, [(HOST, text)])
    urls = [HOST + p for p in ("/a/b", "/a", "/b", "/x/y", "/x/z", "/")]
    for agent in ("reader/1.0", "someone"):
        # in the order of the file, whatever the standard library of this version makes of it
        own = {"reader/1.0": [True, True, True, True, False, True], "someone": [False, False, True, True, True, True]}[agent]
        assert allowed(spark, rules, urls, agent, first=True) == own


def test_gates_of_a_crawl(spark, tmp_path):
    page = lambda p, relevant=True: (HOST + p, relevant)
    pages = spark.createDataFrame([page("/"), page("/a", False), page("/b"), page("/private/c"), page("/d", False), page("/e"), page("/f"), ("http://other.org/g", True)], "url string, relevant boolean")
    links = spark.createDataFrame([(HOST + a, b if "://" in b else HOST + b) for a, b in [("/", "/a"), ("/", "/private/c"), ("/", "http://other.org/g"), ("/", "/missing"), ("/a", "/b"), ("/b", "/d"), ("/d", "/e"), ("/private/c", "/f"), ("/b", "/a")]], "url string, target string")
    got = documents.crawl(pages, links, pages.filter(f"url = '{HOST}/'").select("url"), ["example.org"], f"file://{tmp_path}/c", depth=4, rules=rules_of(spark, [(HOST, FILE)]), agent="reader")
    # seen, depth, host, robots, then what is there; an irrelevant page's links count near a seed alone
    assert sorted(map(tuple, got.collect())) == [(HOST + "/", 0), (HOST + "/a", 1), (HOST + "/b", 2), (HOST + "/d", 3)]
