import re

from lumenspan.llm import urls

RULES = [*urls.RULES, ("block", "bad.net", "/")]


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(url):
    host, path = parse(url)
    fit = [(len(h + p), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def link(target):
    return f'<html><head><link rel="canonical" href="{target}"></head>'


PAGES = [
    (1, "https://a.Example.org/es/1", None),
    (2, "https://example.org/en/2", ""),
    (3, "http://X.example.net/en/3?utm_source=f", link("https://bad.net/q")),
    (4, "HTTP://x.example.net/en/3?utm_source=f", "<p>"),
    (5, "https://y.net/a", '<META HTTP-EQUIV=refresh content="0; URL=/b">'),
    (6, "https://y.net/b", "<link href='c?ref=x' rel=canonical>"),
    (7, "https://y.net/c?ref=x", link("//bad.net/z")),
    (8, "https://z.net/d", link("https://shop.com/fr/1")),
    (9, "https://z.net/d", link("https://bad.net/w")),
    (10, None, link("https://bad.net/")),
    (11, "no scheme", "<p>"),
    (12, "https://shop.com/de/7", None),
    (13, "https://org/", None),
    (14, "https://notorg", None),
    (15, "https://clean.net/p?page=2", None),
    (15, "https://clean.net/p?page=2", None),
    (None, "https://bad.net/q", "x" * 200_000),
    (16, "ftp://org://x/?a", None),
    (17, "https://m.net/e", None),
    # No link makes other spellings aliases.
    (18, "http://x.com/de", None),
    (19, "http://x.example.net/en/3", None),
    (20, "https://y.net/c?ref=x#top", None),
    # What stands in comments, scripts and text areas is no link, nor is another relation.
    (21, "https://c.net/1", f"<!-- {link('https://bad.net/1')} --><p>"),
    (22, "https://c.net/2", f"<SCRIPT>var x = '{link('https://bad.net/1')}'</script><style>{link('https://bad.net/1')}"),
    (23, "https://c.net/3", '<link rel="non-canonical" href="https://bad.net/1"><link data-rel="canonical" href="https://bad.net/1">'),
    (24, "https://c.net/4", '<link rel="alternate canonical" title="a" href="https://bad.net/1">'),
    # Relative targets.
    (25, "https://s.com/a/b/c", link("../../de/./x")),
    (26, "https://s.com/a/d?x=1", link("../../../de/..")),
    (27, "https://s.com/p?q=2", link("?q=3")),
    (28, "https://s.com/p?q=3", link("https://bad.net/../1")),
    (29, "https://c.net/6", link("mailto:a@bad.net")),
    (30, "https://c.net/7", link("#top")),
]
BLOCKED = {3, 4, 5, 6, 7, 17, 24, 25, 27, 28}


def expected(redirect):
    out = []
    for i, url, _ in PAGES:
        r, v = rule(url)
        out.append((i, *parse(url), r, v or ("block" if i in BLOCKED - (set() if redirect else {17}) else "allow")))
    return sorted(out, key=str)


def test_judge(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, host string")
    assert sorted(map(tuple, urls.judge(pages, RULES).collect()), key=str) == expected(False)
    more = spark.createDataFrame([("https://m.net/e", "https://hop.net/1"), ("https://hop.net/1", "http://bad.net/"), (None, "https://m.net/e")], "source string, target string")
    assert sorted(map(tuple, urls.judge(pages, RULES, more).collect()), key=str) == expected(True)
    assert urls.judge(pages.limit(0), RULES).collect() == []


def test_sql(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = con.execute(urls.ORACLE.replace("('block','com','/de/')", "('block','com','/de/'), ('block','bad.net','/')")).fetchall()
    assert sorted(want, key=str) == expected(False)
