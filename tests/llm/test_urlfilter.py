"""Verdicts against trying every rule on every url."""

import random

import pytest

from vicinal.llm import urlfilter


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host_end])
    path = rest[host_end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def by_hand(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v == "block") for v, h, p in rules if (host == h or (h and host.endswith("." + h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], default if best is None else "block" if best[3] else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?/en/", "http://a.b.example.com/en/", "http://badexample.com/en/",
    "http://x.net/es", "http://x.net/es/", "http://net/fr/1", "http://x.org/en/", "http://É.com/ß/漢?x", "http://example.com:80/en/", "ftp://a://b.com/", "http://com/", "http://.com/x", "http://com./x", "http://a.com./x", "http://e\nx.com/a\nb#c",
    "http://" + "." * 200_000 + "com/" + "x" * 200_000, "http://example.com/" + "en/" * 100_000,
]
RULES = [*urlfilter.RULES, ("block", "example.com", "/EN"), ("block", "com", ""), ("allow", "a.com", "/x"), ("block", "x.org", "/en/1"), ("block", "x.org", "/é漢/"), ("allow", "b.x.org", "/en/1"), ("block", "", "/only")]


def cases():
    rng = random.Random(7)
    hosts = ["x.org", "b.x.org", "a.b.x.org", "com", "example.com", "www.example.com", "q.www.example.com", "net", "X.NET", "", "ax.org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/12", "/EN/", "/é漢/1", "/é", "/es/", "/fr/1", "/only"]
    return URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]


@pytest.mark.parametrize("most_rules", [100, 0])
@pytest.mark.parametrize("rules", [urlfilter.RULES, RULES, RULES[:1], []])
def test_as_by_hand(spark, rules, most_rules):
    pages = spark.createDataFrame(list(enumerate(cases())), "page_id bigint, url string").repartition(3)
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, given, most_rules=most_rules).collect()}
    assert got == {i: by_hand(u, rules) for i, u in enumerate(cases())}


def test_equal_digests_are_confirmed_on_the_strings(tmp_path):
    """With one digest for all, every probe collides with every entry."""
    one = lambda text: 7
    entries = [(b"a", 1), (b"bb", 2), (b"", 3), (b"a", 4), ("é".encode(), 5)]
    urlfilter.write_digest_array([*entries, (b"bb", 2)], f"{tmp_path}/x", one)
    found = urlfilter.DigestArray(f"{tmp_path}/x", one)
    assert sorted(found.find([b"bb", b"c", b"a", b"", b"bb"])) == [(0, 2), (2, 1), (2, 4), (3, 3), (4, 2)]


def test_keys_are_sorted_and_mapped(tmp_path):
    entries = [(f"host{i}.example".encode(), i) for i in range(5000)]
    urlfilter.write_digest_array(entries, f"{tmp_path}/x")
    array = urlfilter.DigestArray(f"{tmp_path}/x")
    assert type(array.keys).__name__ == "memmap" and (array.keys[1:] >= array.keys[:-1]).all()
    asked = [f"host{i}.example".encode() for i in range(0, 6000, 3)]
    assert sorted(array.find(asked)) == [(j, i) for j, i in enumerate(range(0, 6000, 3)) if i < 5000]
    urlfilter.write_digest_array([], f"{tmp_path}/none")
    assert list(urlfilter.DigestArray(f"{tmp_path}/none").find([b"a"])) == []


def test_odd_tables(spark):
    rules = spark.createDataFrame([("allow", "A.com", "/"), ("block", "a.com", "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/", "h", "p"), (1, "http://a.com/", "h", "p"), (None, None, None, None)], "page_id bigint, url string, host string, row string")
    rows = urlfilter.filter_urls(pages, rules).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["row"] or "", r["rule"] or "", r["verdict"]) for r in rows) == [(0, "", "", "", "allow"), (1, "a.com", "p", "a.com/", "block"), (1, "a.com", "p", "a.com/", "block")]
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    for bad in (("allow", "a/b", "/"), ("allow", "a", "x"), (None, "a", "/")):
        with pytest.raises(ValueError, match="a rule has"):
            urlfilter.filter_urls(pages, spark.createDataFrame([bad], "verdict string, host string, path string"))
