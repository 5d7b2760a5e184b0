import random
import re

from riskloom.llm import url_rules


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_registered_rules(spark):
    rnd = random.Random(2)
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "x://Example.ORG:80/es/", "http://a..org//es", "http://é.com/fr/é", "http://xcom/fr/", "http://com?/fr/", "a://b://c.org/"]
    for _ in range(300):
        host = rnd.choice(["", "www.", "A.b."]) + rnd.choice(["example.org", "example.com", "x.org", "com", "notexample.org", "example.net"])
        urls.append(f"https://{host}{rnd.choice(['', '/', '/es/1', '/en/1', '/en/12', '/en/2', '/fr/', '/de/x', '/es'])}{rnd.choice(['', '?q=/es/', '#x'])}")
    check(spark, urls + urls[:20], url_rules.RULES)


def test_nested_rules(spark):
    rnd = random.Random(4)
    rules, seen = [], set()
    for _ in range(60):
        key = (rnd.choice(["a", "b.a", "c.b.a", "d"]), "/" + "".join(rnd.choice("xy") for _ in range(rnd.randint(0, 4))))
        if key not in seen:
            seen.add(key)
            rules.append((rnd.choice(["allow", "block"]), *key))
    urls = [f"s://{rnd.choice(['a', 'b.a', 'c.b.a', 'z.c.b.a', 'd', 'e'])}/{''.join(rnd.choice('xyz') for _ in range(rnd.randint(0, 6)))}" for _ in range(300)]
    check(spark, urls, rules)


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert url_rules.judge_urls(pages.where("false"), url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    assert url_rules.judge_urls(pages, url_rules.rule_table(spark, [])).first()["verdict"] == "allow"
