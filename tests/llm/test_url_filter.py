import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import url_filter
from lectern.llm.entry import RULES


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [(len(r), r, what) for what, r in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return max(fits)[1:] if fits else (None, None)


def brute(urls):
    """Verdicts by plain counting: interpolated Witten-Bell models over strings."""
    k, facts = url_filter.ORDER, [(*split(u), *ruled(*split(u))) for u in urls]
    is_held = lambda u: hashlib.md5(u.encode()).hexdigest()[0] in url_filter.HELD_OUT
    follow = {w: [defaultdict(Counter) for _ in range(k + 1)] for w in ("allow", "block")}
    known = Counter((h + p, v) for h, p, _, v in facts)
    for (u, v), m in known.items():
        if v and not is_held(u):
            s = "\2" * k + u + "\3"
            for i in range(k, len(s)):
                for o in range(k + 1):
                    follow[v][o][s[i - o : i]][s[i]] += m

    def chance(w, context, c):
        p = 1 / 256
        for o in range(k + 1):
            seen = follow[w][o][context[k - o :]]
            total, kinds = sum(seen.values()), len(seen)
            if total:
                p = (seen[c] + kinds * p) / (total + kinds)
        return p

    def score(u):
        s = "\2" * k + u + "\3"
        return sum(math.log(chance("allow", s[i - k : i], s[i])) - math.log(chance("block", s[i - k : i], s[i])) for i in range(k, len(s))) / (len(s) - k)

    of = {w: [score(u) for (u, v) in known if v == w and is_held(u)] for w in ("allow", "block")}
    line = 0.0
    if all(of.values()):
        mean = {w: sum(x) / len(x) for w, x in of.items()}
        sd = {w: math.sqrt(sum((y - mean[w]) ** 2 for y in x) / len(x)) for w, x in of.items()}
        both = sd["allow"] + sd["block"]
        line = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / both if both else sum(mean.values()) / 2
    return [(h, p, r, v or ("allow" if score(h + p) - line >= 0 else "block")) for h, p, r, v in facts]


def urls():
    out = [f"https://{h}/{p}/{i}-{w}?q={i}#x" for i, w in enumerate(["mill", "grain", "río", "win-cash", "free"] * 8) for h, p in (("www.example.net", "en"), ("shop.net", "de"), ("a.Example.COM", "de"), ("site.org", "fr"), ("site.org", "es"), ("example.com", "fr"))]
    return [*out, *out[:50], None, "", "no scheme", "ftp://", "http://net", "http://x.net/a://b", "//half", "http://EXAMPLE.net/en/", "http://example.net/EN/", "http://notexample.com/de/", "http://sub.example.com/de/\n?x"]


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(urls())]
    df = spark.createDataFrame(rows, "page_id int, url string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, RULES).collect()}
    assert got == dict(enumerate(brute([u for _, u in rows])))


def test_one_class_only_and_empty(spark):
    df = spark.createDataFrame([("http://a.org/x",), ("http://b.org/fr/",), (None,)], "url string")
    got = url_filter.filter_urls(df, RULES)
    assert sorted(r["verdict"] for r in got.collect()) == sorted(v for *_, v in brute(["http://a.org/x", "http://b.org/fr/", None]))
    assert url_filter.filter_urls(df.limit(0), RULES).collect() == []


@pytest.mark.parametrize("n", [60_000])
def test_very_long_urls_and_clashing_columns(spark, n):
    df = spark.createDataFrame([(1, "http://a.org/fr/", 5, "x"), (2, "http://a.org/" + "ab" * n, 6, "y"), (3, "http://b.net/", 7, None)], "__i int, url string, __v int, Verdict string")
    out = url_filter.filter_urls(df, RULES)
    assert out.columns == ["__i", "url", "__v", "host", "path", "rule", "verdict", "lm_score"]
    got = {r["__i"]: r for r in out.collect()}
    assert {i: r["__v"] for i, r in got.items()} == {1: 5, 2: 6, 3: 7} and len(got[2]["path"]) == 2 * n + 1 and got[3]["verdict"] == "block"
