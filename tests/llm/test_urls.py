import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from appcorpus.llm import urls

SF = "/root/testdata/sf0.01"
HEX = r"[0-9A-Fa-f]{8}(-?[0-9A-Fa-f]{4}){3}-?[0-9A-Fa-f]{12}|(?=.*[0-9])[0-9A-Fa-f]{16,}"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules):
    fits = [(len(r), [-ord(c) for c in r], v, r) for v, r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return max(fits)[2:] if fits else (None, None)


def shape(segment):
    segment = segment.replace("*", "%2A").replace("{", "%7B")
    m = re.fullmatch(r"(?s)(.+)(\.[A-Za-z]{1,5})", segment)
    name, extension = m.groups() if m else (segment, "")
    if re.fullmatch("[0-9]+", name):
        return "{n}" + extension
    if re.fullmatch(r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", name):
        return "{date}" + extension
    if re.fullmatch(HEX, name):
        return "{hex}" + extension
    if re.fullmatch(r"(?=.*[0-9])[0-9A-Za-z_-]{20,}", name):
        return "{id}" + extension
    return re.sub("[0-9]+", "{n}", name) + extension


def by_hand(all_urls, rules, purity=urls.PURITY, weight=urls.PRIOR, apart=urls.APART, depth=urls.DEPTH):
    """url: (host, path, rule, template, verdict), the tree built node by node in memory."""
    paths, rows = defaultdict(lambda: [0, 0]), []
    for u in all_urls:
        host, path = split(u)
        parts = path.removeprefix("/").split("/") if path else []
        shapes = tuple(map(shape, parts[:depth])) + (("**",) if len(parts) > depth else ())
        verdict, rule = ruled(host, path, rules)
        paths[host, shapes][0] += verdict is not None
        paths[host, shapes][1] += verdict == "block"
        rows.append((u, host, path, rule, verdict, shapes))
    total = [sum(x[k] for x in paths.values()) for k in (0, 1)]
    prior = total[1] / total[0] if total[0] else 0.0
    at, level = {k: "" for k in paths}, 0
    while going := [k for k in paths if len(k[1]) > level]:
        children = defaultdict(lambda: [0, 0, set()])
        for k in going:
            after = k[1][level + 1] if len(k[1]) > level + 1 else None
            c = children[k[0], at[k], k[1][level]]
            c[0] += paths[k][0]
            c[1] += paths[k][1]
            c[2].add("end" if after is None else "slash" if after == "" else "wild" if "{" in after else "word")
        pool = defaultdict(lambda: [0, 0])
        for (host, where, _), c in children.items():
            pool[host, where][0] += c[0]
            pool[host, where][1] += c[1]
        side = {}
        for (host, where, child), c in children.items():
            n, b = pool[host, where]
            rate, m = (b + weight * prior) / (n + weight), max(c[0], 1)
            off = (c[1] - c[0] * rate) / m / max(math.sqrt(rate * (1 - rate) / m), 1e-9)
            side[host, where, child] = "?" if c[0] == 0 else ">" if off > apart else "<" if off < -apart else "=", ",".join(sorted(c[2]))
        literal = lambda c: "{" not in c and c not in ("", "**")
        alike = Counter((h, w, side[h, w, c]) for h, w, c in children if literal(c))
        for k in going:
            key = (k[0], at[k], k[1][level])
            s, kinds = side[key]
            node = f"*{'' if s == '=' else s}({kinds})" if literal(key[2]) and alike[key[0], key[1], side[key]] > 1 else key[2]
            at[k] += "/" + node
        level += 1
    leaf = defaultdict(lambda: [0, 0])
    for k, x in paths.items():
        leaf[k[0], at[k]][0] += x[0]
        leaf[k[0], at[k]][1] += x[1]
    out = {}
    for u, host, path, rule, verdict, shapes in rows:
        n, b = leaf[host, at[host, shapes]]
        rejected = (b + weight * prior) / (n + weight) >= purity if n + weight else False
        out[u] = (host, path, rule, at[host, shapes], verdict or ("block" if rejected else "allow"))
    return out


ODD = [None, "", "no scheme", "http://", "://", "HTTP://Www.EXAMPLE.com/en/x", "https://example.com/en/", "https://example.com/en", "http://notexample.com/en/5", "http://a.net/es/", "http://a.net", "http://a.net?q=/fr/", "http://net/fr/1", "x://y://z/es/",
       "http://a.net/fr//double//", "http://b.org/" + "/".join(f"d{i}x" for i in range(40)), "http://c.org/" + "x" * 20_000, "http://c.org/a/{n}/*", "http://c.org/2024-01-02/0123456789abcdef01.html/aB3_aaaaaaaaaaaaaaaaaaaaa"]
#: On one host, blocked and other branches: the blocked ones are alike, so they merge, and take pages beside the rules along.
MIXED = [f"http://shop.net/{'es' if i % 2 else 'fr'}/item-{i}" for i in range(60)] + [f"http://shop.net/en/item-{i}" for i in range(40)] + [f"http://blog.org/{w}{'abcdefgh'[i % 8]}/post" for i, w in enumerate(["red", "blue", "green"] * 30)]
MIXED += [f"http://spam.org/{w}/{i}" for w in ("pills", "casino", "loans") for i in range(30)] + [f"http://spam.org/news/{i}" for i in range(30)] + ["http://spam.org/pills/new-one", "http://spam.org/casino/new-one", "http://spam.org/loans/x/y"] * 3
SPAM = [("block", "spam.org/pills/1"), ("block", "spam.org/casino/2"), ("block", "spam.org/loans/"), ("allow", "spam.org/news/"), ("allow", "shop.net/en/"), ("block", "net/es/"), ("block", "shop.net/fr/")]


@pytest.mark.parametrize("rules, how", [(urls.RULES, {}), (SPAM, {}), (SPAM, {"purity": 0.6, "weight": 1.0, "apart": 1.0, "depth": 2}), ([], {})])
def test_same_as_by_hand(spark, rules, how):
    rows = ODD + MIXED + MIXED[:5]
    frame = spark.createDataFrame([(i, u, None if i % 2 else "x", "mine") for i, u in enumerate(rows)], "page_id long, url string, host string, filter string").withColumn("_h", F.lit(1))
    found = urls.filter_urls(frame, rules=rules, **how)
    got, expected = found.collect(), by_hand(rows, rules, **how)
    assert len(got) == len(rows) and set(found.columns) == set(frame.columns)
    for r in got:
        f = r["filter"]
        assert (f.host, f.path, f.rule, f.template, f.verdict) == expected[r.url], r.url
    assert {r.host for r in got} == {None, "x"}
    assert urls.filter_urls(frame.limit(0), rules=rules).count() == 0


def test_method_rejects_and_keeps(spark):
    """Pages without a rule under templates whose labelled pages are blocked go, those of the allowed branch stay."""
    rows = MIXED + ["http://spam.org/pills/777", "http://spam.org/news/777"]
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.url: r["filter"] for r in urls.filter_urls(frame, rules=SPAM).collect()}
    assert got["http://spam.org/pills/777"].verdict == "block" and got["http://spam.org/pills/777"].rule is None
    assert got["http://spam.org/news/777"].verdict == "allow" and got["http://blog.org/reda/post"].verdict == "allow"


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_query_on_given_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", broadcast)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    expected = by_hand([p.url for p in pages], urls.RULES)
    got = urls.op12(spark, SF)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and "Python" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert len(rows) == len(pages)
    of = {p.page_id: p.url for p in pages}
    for r in rows:
        assert (r.host, r.path, r.rule, r.template, r.verdict) == expected[of[r.page_id]]
