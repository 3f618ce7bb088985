"""URL rules and path templates, against a plain version that holds each host's tree in memory."""

import math
import re
from collections import defaultdict

import pytest

from tidegauge.llm import url_templates
from tidegauge.llm.common import read_table


def plain_place(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fit = [r for r in url_templates.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def plain_tree(pages, labels, share=1 / 32, least=4, alpha=0.05, weight=10.0, depth=8):
    """pages of (page_id, url), labels of (page_id, bad) -> {(host, path): (template, purity)}."""
    bad, good = defaultdict(int), defaultdict(int)
    for p, b in labels:
        if b is not None and p is not None:
            (bad if b else good)[p] += 1
    urls = []
    for page_id, url in pages:
        host, path = plain_place(url)
        shaped = re.sub("[0-9]+", "{n}", re.sub(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{16,}(?![0-9A-Za-z])", "{h}", path, flags=re.A), flags=re.A)
        segs = shaped.removeprefix("/").split("/", depth - 1) if shaped else []
        urls.append((host, path, segs, good[page_id] if page_id is not None else 0, bad[page_id] if page_id is not None else 0))
    g0, b0 = sum(u[3] for u in urls), sum(u[4] for u in urls)
    prior = (g0 + 1) / (g0 + b0 + 2)
    out = {}

    def kind(segs, k):
        s = segs[k] if k < len(segs) else None
        return "end" if s is None else "slash" if s == "" else "number" if s == "{n}" else "numbered" if "{n}" in s or "{h}" in s else "word"

    def purity(rows, above):
        g, b = sum(r[3] for r in rows), sum(r[4] for r in rows)
        return (g + weight * above) / (g + b + weight)

    def apart(x, y, k):
        spread = math.sqrt(0.5 * math.log(2 / alpha))
        for c in ("end", "slash", "number", "numbered", "word"):
            a, b = (sum(kind(r[2], k + 1) == c for r in z) / len(z) for z in (x, y))
            if abs(a - b) > spread * (len(x) ** -0.5 + len(y) ** -0.5):
                return True
        a, b = (sum(r[3] + r[4] for r in z) for z in (x, y))
        return bool(a and b) and abs(sum(r[4] for r in x) / a - sum(r[4] for r in y) / b) > spread * (a**-0.5 + b**-0.5)

    def grow(rows, k, node, p):
        kids = defaultdict(list)
        for r in rows:
            if len(r[2]) == k:
                out[r[0], r[1]] = (node, p)
            else:
                kids[r[2][k]].append(r)
        n = sum(map(len, kids.values()))
        named = {s: x for s, x in kids.items() if len(x) >= least and len(x) >= share * n}
        groups = []
        for s in sorted(named, key=lambda s: (-len(named[s]), s)):
            for g in groups:
                if not apart(named[g[0]], named[s], k):
                    g.append(s)
                    break
            else:
                groups.append([s])
        parts = [(g[0] if len(g) == 1 else "(" + "|".join(sorted(g)) + ")", [r for s in g for r in named[s]]) for g in groups]
        rest = [r for s, x in kids.items() if s not in named for r in x]
        for name, own in parts + ([("{*}", rest)] if rest else []):
            grow(own, k + 1, f"{node}/{name}", purity(own, p))

    by_host = defaultdict(list)
    for u in urls:
        by_host[u[0]].append(u)
    for rows in by_host.values():
        grow(rows, 0, "", purity(rows, prior))
    return out


def compare(pages, labels, **parameters):
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    want = plain_tree(rows, [tuple(r) for r in labels.collect()], **parameters)
    got = url_templates.judge(pages, labels, **parameters).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(p) for p, _ in rows)
    at = defaultdict(set)
    for p, url in rows:
        at[p].add(plain_place(url))
    for r in got:
        assert (r.host, r.path) in at[r.page_id]
        template, purity = want[r.host, r.path]
        assert r.template == template and r.purity == pytest.approx(purity, rel=1e-12)
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule[0] + rule[1] if rule else None)
        assert r.verdict == (rule[2] if rule else "block" if purity < 0.5 else "allow")
    return got


def test_trees_equal_plain_version(spark, small):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    labels = url_templates.page_labels(pages, read_table(spark, "/root/testdata/sf0.01", "labels"))
    assert labels.count() > 50
    compare(pages, labels)
    compare(pages, labels, share=0.3, least=1, alpha=0.9, weight=1.0, depth=1)


def test_bad_branch_of_a_host_is_cut_and_the_rest_stays(spark):
    rows, marks = [], []
    for k in range(600):
        section, bad = (("news", False), ("casino", True), ("blog", False))[k % 3]
        rows.append((k, f"https://Mixed.Example.org/{section}/{'item' if k % 2 else 'x'}{k * 7919}/page-{k}.html?q=/casino/"))
        if k % 5 == 0:
            marks.append((k, bad))
    rows += [(1000 + k, f"http://blog.example.org/{w}") for k, w in enumerate(["a1b2c3d4e5f60718", "slug-one", "slug-two", "other", "q"] * 3)]
    pages, labels = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(marks, "page_id bigint, bad boolean")
    got = {r.page_id: r for r in compare(pages, labels)}
    assert all((got[k].verdict == "block") == (k % 3 == 1) for k in range(600))
    assert got[0].template.startswith("/(blog|news)/") and got[1].template.startswith("/casino/")
    assert {got[1000].template, got[1001].template} == {"/{*}"}


def test_url_edges(spark, monkeypatch):
    urls = [None, "", "no scheme/en/1", "http://", "HTTPS://WWW.Example.COM/en/9", "x://Example.com/en/?a", "http://example.com", "http://com/", "a://b://c/d", "http://é.NET/es/\n/x", "http://n.net/fr/1#f", "http://deep.org/" + "a/" * 40, "http://long.org/" + "7x" * 60_000, "http://h.org//", "http://h.org/", "http://h.org"]
    rows = [(k, u) for k, u in enumerate(urls)] * 2 + [(None, "http://h.org/null"), (3, "http://h.org/other")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", *[f"'clash' as {c}" for c in ("host", "path", "rule", "node", "n", "shaped")])
    labels = spark.createDataFrame([(0, True), (2, False), (2, None), (None, True), (99, True), (13, True)], "page_id bigint, bad boolean")
    by = {r.page_id: r for r in compare(pages, labels) if r.page_id not in (3, None)}
    assert (by[0].host, by[0].path, by[1].host) == ("", "", "")
    assert (by[4].rule, by[4].verdict) == ("www.example.com/en/", "allow")
    assert (by[5].rule, by[5].verdict) == ("example.com/en/", "block")
    assert by[6].rule is None and by[7].rule == "com/" and by[9].rule == "net/es/"
    assert (by[8].host, by[8].path) == ("b:", "//c/d")
    assert by[11].template == "/{*}" * 8  # the rest of a deep path is one segment
    monkeypatch.setattr(url_templates, "BROADCAST_PATHS", 0)
    compare(pages, labels)
    assert url_templates.judge(pages.limit(0), labels).count() == 0
    assert url_templates.judge(pages, labels.limit(0)).count() == len(rows)
