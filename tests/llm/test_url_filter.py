import random
from urllib.parse import urljoin, urlsplit

from siftstone.llm.queries import URL_RULES
from siftstone.llm.url_filter import RULE_SCHEMA, html_edges, judge_urls


def judged(spark, urls, redirects=None, html=None):
    pages = spark.createDataFrame([(i, u, (html or {}).get(i), "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    edges = None if redirects is None else spark.createDataFrame(redirects, "src string, dst string")
    rows = judge_urls(pages, spark.createDataFrame(URL_RULES, RULE_SCHEMA), edges).collect()
    assert len(rows) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_rules(spark):
    urls = ["http://WWW.Example.com/en/12?x", "https://example.com/en/7#t", "http://notexample.com/en/7", "http://a.example.net/de/81", "http://b.net/de/", "http://c.org/es", "http://c.org/es/1", None, "c.org/es/1", "", "x://com/en/://org/es/", "http://com?/en/"]
    got = judged(spark, urls + [urls[0]])
    assert got[0] == ("www.example.com", "/en/12", "com/en/", "block") == got[12]
    assert got[1] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("notexample.com", "/en/7", "com/en/", "block")
    assert got[3] == ("a.example.net", "/de/81", "example.net/de/8", "block")
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][:3] == ("com", "/en/://org/es/", "com/en/") and got[11] == ("com", "", None, "allow")


def test_decisions_pass_over_aliases_and_allow_goes_first(spark):
    html = {0: '<html><LINK href="http://x.com/en/1" rel="canonical">', 3: "<meta http-equiv='refresh' content='0; URL=/a?b=1&amp;c=2'>", 5: '<link rel=canonical href=//q.net/fr/2>'}
    urls = ["http://p.org/fr/1", "http://p.org/fr/2", "http://p.org/fr/3", "http://z.org/b", "http://z.org/a?b=1&c=2#f", "http://z.org/c", "http://example.com/en/7"]
    redirects = [("http://p.org/fr/2", "http://p.org/fr/1"), ("http://z.org/a?b=1&c=2", "http://example.com/en/7"), ("http://z.org/a?b=1&c=2", "http://u.org/es/1"), (None, "http://u.org/es/1")]
    got = {k: v[2:] for k, v in judged(spark, urls, redirects, html).items()}
    assert got[0] == got[1] == (None, "block") and got[2] == (None, "allow")
    assert got[3] == got[4] == (None, "allow") and got[5] == (None, "allow") and got[6] == ("example.com/en/7", "allow")


def test_relative_links(spark):
    page = "http://H.org/a/b/page1?q=1#t"
    want = {
        "page2.html": "http://h.org/a/b/page2.html", "?id=3": "http://h.org/a/b/page1?id=3", "../a/b": "http://h.org/a/a/b", "./x": "http://h.org/a/b/x", "../../../x?y=../z": "http://h.org/x?y=../z",
        "..": "http://h.org/a/", ".": "http://h.org/a/b/", "../..": "http://h.org/", "/login?next=https://other.org/x": "http://h.org/login?next=https://other.org/x", "x?next=http://o.org/": "http://h.org/a/b/x?next=http://o.org/",
        "/c/../d/": "http://h.org/d/", "//o.org/x": "http://o.org/x", "HTTPS://o.org/x": "HTTPS://o.org/x", "#top": page, "mailto:a@o.org": None,
    }
    rows = [(page, f'<link rel="canonical" href="{href}">') for href in want] + [("http://h.org", '<meta http-equiv=refresh content="0; url=x">'), ("no-scheme", '<link rel="canonical" href="x">')]
    got = [(r.src, r.dst) for r in html_edges(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == sorted([(page, x) for x in want.values() if x] + [("http://h.org", "http://h.org/x")])
    urls = ["http://p.org/fr/1", "http://p.org/es/2", "http://q.org/fr/1"]
    found = judged(spark, urls, None, {0: "<meta http-equiv=refresh content='0; url=../es/2'>", 2: "<link rel=canonical href='/x?next=http://p.org/es/2'>"})
    assert [found[i][3] for i in range(3)] == ["block", "block", "allow"]


def test_many_aliases_of_one_blocked_page(spark):
    urls = [f"http://h{i}.org/fr/{i}" for i in range(300)]
    got = judged(spark, urls, [(u, "http://t.org/es/0") for u in urls[:200]])
    assert [v[3] for _, v in sorted(got.items())] == ["block"] * 200 + ["allow"] * 100


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(pages, spark.createDataFrame(URL_RULES, RULE_SCHEMA)).collect() == []


def test_random_alias_graphs_match_brute_force(spark):
    rng = random.Random(5)
    paths = ["/en/7", "/en/1", "/de/1", "/de/8", "/es/1", "/fr/1", "/fr/2", "/fr/3?q=1"]
    for _ in range(3):
        urls = [f"http://{rng.choice('abc')}.{h}{p}" for h in ("example.com", "x.net", "y.org", "example.net") for p in paths]
        links = {i: rng.choice(paths + ["2", "?id=3", "../fr/9", "http://z.org/es/4?k#f"]) for i in rng.sample(range(len(urls)), 6)}
        html = {i: f'<link rel="canonical" href="{x}">' for i, x in links.items()}
        redirects = [(rng.choice(urls), rng.choice(urls + ["http://w.org/es/2", "http://w.org/fr/2"])) for _ in range(10)]
        node = lambda u: (urlsplit(u).netloc, urlsplit(u).path, urlsplit(u).query)

        def own(u):
            host, path = urlsplit(u).netloc, urlsplit(u).path
            fits = [(len(h + p), a) for h, p, a in URL_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
            return max(fits)[1] if fits else None

        edges = redirects + [(urls[i], urljoin(urls[i], x)) for i, x in links.items()]
        group = {node(u): node(u) for e in edges for u in e}
        for _ in group:
            for a, b in edges:
                group[node(a)] = group[node(b)] = min(group[node(a)], group[node(b)])
        said = {}
        for u in {u for e in edges for u in e}:
            said.setdefault(group[node(u)], set()).add(own(u))
        want = {}
        for i, u in enumerate(urls):
            others = said.get(group.get(node(u)), set())
            want[i] = own(u) or ("block" if "block" in others and "allow" not in others else "allow")
        assert {i: v[3] for i, v in judged(spark, urls, redirects, html).items()} == want


def test_tags_as_a_browser_reads_them(spark):
    target = "http://c.org/es/1"
    good = [
        f'<link data-rel="canonical" rel="next" href="{target}">', f'<!-- <link rel="canonical" href="{target}"> -->', f"<script>var x = '<link rel=\"canonical\" href=\"{target}\">';</script>", f'<link rel="canonical" data-href="{target}" href="/fr/2">',
        f'<link rel="alternate" title="rel=canonical" href="{target}">', f"<title><link rel=canonical href={target}></title>", f'<meta name="refresh" content="0; url={target}">', f'<link rel="canonicals" href="{target}">', f'<links rel="canonical" href="{target}">',
        f'<link rel="canonical" href="/fr/2" href="{target}">', "<meta http-equiv=refresh content=30>", f'<!-- open <link rel="canonical" href="{target}">', f"<p>&lt;link rel=canonical href={target}&gt;</p>", "<link rel=canonical>",
    ]
    bad = [
        f'<link rel="alternate canonical" href="{target}">', f'<link title="a > b" rel="canonical" href="{target}">', f'<meta http-equiv="refresh" content="0; {target}">', f'<link rel="canonical" href=" {target} ">', '<base href="http://c.org/es/"><link rel="canonical" href="1">',
        f'<LINK\nREL = canonical\nHREF = {target} />', f"<link href='{target}' rel='CANONICAL'>", f"<meta content='3;URL=\"{target}\" x' http-equiv=Refresh>", f'<script src="x"></script><!-- a --><link rel="canonical" href="{target}">', f'<meta http-equiv="refresh" content="0,url={target}">',
        f'<style>a > b {{}}</style><link itemprop=url rel=canonical href="{target}"><!--', '<link rel="canonical" href="x/../1"><base target=_top><base href="//c.org/es/0"><base href="/fr/">', f'<link/rel="canonical"/href="{target}">', f'<link rel="canonical" href="http://c.org/es/\n1">',
    ]
    rows = good + bad
    urls = [f"http://p{i}.org/fr/1" for i in range(len(rows))]
    found = judged(spark, urls, None, dict(enumerate(rows)))
    assert [i for i in range(len(rows)) if (found[i][3] == "block") != (i >= len(good))] == []


def test_long_odd_pages_take_time_in_proportion(spark):
    import time

    n = 200_000
    html = {0: "<link " * n, 1: '<link "' * n, 2: "<!--" * n, 3: "<script>" * n, 4: "<link rel='canonical' " + "a=b " * n + "href='http://c.org/es/1'>", 5: "<" * n, 6: "<link rel=canonical href=" + "x" * n + ">", 7: "<meta http-equiv=refresh content='" + "0" * n}
    began = time.time()
    found = judged(spark, [f"http://p{i}.org/fr/1" for i in range(len(html))], None, html)
    assert time.time() - began < 60
    assert [found[i][3] for i in range(len(html))] == ["allow"] * 4 + ["block"] + ["allow"] * 3


def test_a_table_of_pages_with_links(spark):
    """Chains of canonical links and refreshes that end at pages with and without a rule."""
    rng, html, urls, want = random.Random(3), {}, [], {}
    ends = {"http://c.org/es/1": "block", "http://example.com/en/7": "allow", "http://c.org/fr/1": "allow", "http://x.com/en/2": "block"}
    for chain in range(60):
        end = rng.choice(list(ends))
        names = [f"http://h{chain}.info/{k}" for k in range(rng.randint(1, 5))] + [end]
        for here, there in zip(names, names[1:]):
            i = len(urls)
            urls.append(here)
            html[i] = rng.choice(['<head><link rel="canonical" href="{}"></head>', "<meta http-equiv=refresh content='0; url={}'>", '<base href="http://odd.org/"><link rel="x canonical" href="{}">']).format(there)
            want[i] = ends[end]
    # all chains with one end are one component, so what its end says holds for each
    found = judged(spark, urls, None, html)
    assert {i: v[3] for i, v in found.items()} == want
