import itertools
import re
from collections import Counter

from llm_samples import rows_of

from shelfspark.llm.queries import URL_RULES
from shelfspark.llm.url_rules import CONFIDENCE, SUPPORT, judge_urls, mine_rules, url_host, url_path, url_tokens

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.NET/x?y", "https://m.example.net/en/1",
    "https://example.net/english", "http://Example.Com/de/", "http://example.com/de", "http://xexample.com/de/1",
    "ftp://u@example.org:80/fr/2#t", "http://org/fr/", "a://b://c/d", "http://x.org?u=http://net/", "http://é.net/ü",
    "http://x.net\n/p", "://net/", "http:///en/", "http://a.example.com/en/1", "http://a.example.com/en/1",
]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for (h, p), v in URL_RULES.items()
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_host_path_and_rule(spark):
    pages = spark.createDataFrame(
        [(i, u, "h", "x") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "h", "x"), (3, URLS[3], "h", "x")],
        "page_id LONG, url STRING, host STRING, rule STRING")
    expected = []
    for page_id, url in [*enumerate(URLS), (None, "http://a.net/"), (3, URLS[3])]:
        host, path, rule, verdict = judged(url)
        expected.append((page_id, host, path, rule))
    found = judge_urls(pages, URL_RULES)
    assert rows_of(found, "page_id", "host", "path", "rule") == sorted(expected, key=repr)
    verdicts = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    assert all(v == URL_RULES[next(k for k in URL_RULES if k[0] + k[1] == rule)] for rule, v in verdicts.values() if rule)
    assert rows_of(judge_urls(pages.limit(0), URL_RULES), "page_id") == []


def brute_rules(rows, support, confidence):
    """Every combination of tokens, counted over the labelled rows; then the same pruning."""
    rows = [(tokens, label) for tokens, label in rows if label and tokens]
    totals, with_label, without = Counter(label for _, label in rows), Counter(), Counter()
    for tokens, label in rows:
        for n in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), n):
                without[part] += 1
                with_label[part, label] += 1
    kept = {}
    for (part, label), n in sorted(with_label.items(), key=lambda x: (len(x[0][0]), x[0])):
        sure = n / without[part]
        if n / totals[label] >= support and sure >= confidence and not any(
                label == other and set(less) <= set(part) and c >= sure for (less, other), c in kept.items()):
            kept[part, label] = sure
    return {rule: sure for rule, sure in kept.items() if any(t.startswith("path=") for t in rule[0])}


def test_mined_rules_and_verdicts_by_counting(spark):
    import random

    rng = random.Random(4)
    urls = []
    for _ in range(600):
        host = rng.choice(["bad-win", "good", "ads"]) + "." + rng.choice(["example.net", "example.com", "example.org"])
        urls.append(f"http://{host}/{rng.choice(['de', 'en', 'fr'])}/{rng.randint(1, 999)}")
    urls += ["http://bad-win.example.net/de/1"] * 9000 + ["http://new.example.net/x", "http://odd/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING").repartition(4)
    host, path = url_host(pages.url), url_path(pages.url)
    rows = pages.select("page_id", url_tokens(host, path).alias("tokens"))
    tokens = {r.page_id: r.tokens for r in rows.collect()}
    labelled = [(tokens[i], judged(u)[3]) for i, u in enumerate(urls)]
    table = spark.createDataFrame(labelled, "tokens ARRAY<STRING>, label STRING")
    mined = {(t, label): c for t, label, c in mine_rules(table, 0.02, 0.9)}
    brute = brute_rules(labelled, 0.02, 0.9)
    assert mined.keys() == brute.keys() and all(abs(mined[k] - brute[k]) < 1e-9 for k in brute) and mined
    kept = brute_rules(labelled, SUPPORT, CONFIDENCE)
    decided = 0
    for r in judge_urls(pages, URL_RULES).collect():
        own = [(c, len(t), label == "block", label) for (t, label), c in kept.items() if set(t) <= set(tokens[r.page_id])]
        assert r.mined == (max(own)[3] if own else None)
        assert r.verdict == (judged(urls[r.page_id])[3] or r.mined or "allow")
        decided += r.rule is None and r.mined is not None
    assert decided


def test_no_rules_from_nothing(spark):
    assert mine_rules(spark.createDataFrame([], "tokens ARRAY<STRING>, label STRING")) == []


def test_tokens_are_of_the_whole_url(spark):
    far = "/".join(f"p{chr(97 + i)}x" for i in range(26))
    deep = spark.createDataFrame([("a.b.c.d.e.f-g.h9.org", "/" + far + "/" + "z" * 300)], "host STRING, path STRING")
    found = set(deep.select(url_tokens(deep.host, deep.path)).first()[0])
    assert {"host=a", "host=f", "host=g", "host=h0", "path=pzx", "path=" + "z" * 300} <= found and len(found) == 9 + 27


def test_a_rare_label_has_rules_too(spark):
    rows = [(["host=a", "path=x"], "allow")] * 5000 + [(["host=b", "path=y"], "block")] * 3 + [(["host=a", "path=y"], None)]
    rows += [(["host=c", "path=x"], "block")] * 3 + [(["host=c", "path=z"], "allow")] * 60
    table = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING")
    assert {(t, label) for t, label, _ in mine_rules(table)} == {
        (("path=x",), "allow"), (("path=y",), "block"), (("path=z",), "allow"), (("host=c", "path=x"), "block")}
