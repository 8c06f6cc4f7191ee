"""Rules and reputations against plain Python."""

import math

from setlist.llm import url_filter as uf

PAGES = "page_id long, url string, html string, host string, bad string"
LABELS = "doc_id long, quality int, toxic int, n long"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def ruled(host, path, rules=uf.RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def level(host):
    name = host.split("@")[-1]
    head, _, tail = name.rpartition(":")
    name = head if head and not tail.strip("0123456789") else name
    name = name[:-1] if name.endswith(".") else name
    parts = name.split(".")
    if len(parts) < 2 or name.startswith("[") or parts[-1].isdigit():
        return name, name
    k = 2 if ".".join(parts[-2:]) in uf.SUFFIXES else 1
    return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])


def strength(groups):
    groups = [(n, b, m) for n, b, m in groups if n]
    seen, alone, both = (sum(f(n, b, m) for n, b, m in groups) for f in (lambda n, b, m: n * (b / n - m) ** 2, lambda n, b, m: m * (1 - m), lambda n, b, m: m * (1 - m) * (n - 1)))
    r = (seen - alone) / both if both else 0
    return min(uf.STRONGEST, max(uf.WEAKEST, 1 / r - 1)) if r > 0 else uf.STRONGEST


def brute(pages, labels):
    outcome = {}
    for i, q, t, *_ in labels:
        if i is not None and (q is not None or t is not None):
            outcome[i] = max(outcome.get(i, 0), int(q == 0 or t == 1))
    hosts = {}
    for i, url, *_ in pages:
        n, b = hosts.setdefault(split(url)[0], (0, 0))
        hosts[split(url)[0]] = (n + (i in outcome), b + outcome.get(i, 0))
    total = (sum(n for n, _ in hosts.values()), sum(b for _, b in hosts.values()))
    overall = (total[1] + 0.5) / (total[0] + 1)
    prior_of = lambda key: overall
    for name in (lambda h: level(h)[1], lambda h: level(h)[0], lambda h: h):
        sums, prior = {}, {}
        for h, (n, b) in hosts.items():
            s = sums.get(name(h), (0, 0))
            sums[name(h)], prior[name(h)] = (s[0] + n, s[1] + b), prior_of(h)
        k = strength([(n, b, prior[g]) for g, (n, b) in sums.items()])
        mean = {g: (b + k * prior[g]) / (n + k) for g, (n, b) in sums.items()}
        prior_of = lambda h, name=name, mean=mean: mean[name(h)]
    bound = {h: mean[h] - uf.Z * math.sqrt(mean[h] * (1 - mean[h]) / (n + k + 1)) for h, (n, _) in hosts.items()}
    out = []
    for i, url, *_ in pages:
        host, path = split(url)
        rule, verdict = ruled(host, path)
        out.append((i, host, path, rule, verdict or ("block" if bound[host] > uf.MAX_BAD else "allow"), hosts[host][0], hosts[host][1], round(bound[host], 6)))
    return out


def fixture():
    odd = [None, "", "no scheme", "http://", "://x", "HTTP://User@EXAMPLE.org:80/en/12?x#y", "http://a.org", "http://org/", "http://xorg/", "http://example.org/es/a", "http://www.example.org/en/1", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/de/x/fr/",
           "http://a.com?q=/fr/", "http://a.com#://b/", "http://a.com/x://y/", "http://10.0.0.1/a", "http://[::1]:80/", "http://a.co.uk/", "http://b.co.uk./", "http://ÉA.com/", "http://a.com/\nfr/", "http://" + "a." * 5000 + "net/" + "x" * 90_000]
    pages = [(i, u, "h", "x", "x") for i, u in enumerate(odd)]
    at = 1000
    for host, n, bad in [("bad.spam.net", 60, 58), ("new.spam.net", 3, 3), ("fine.net", 80, 4), ("one.fine.com", 1, 1), ("big.com", 900, 90), ("www.worse.co.uk", 40, 39)]:
        for j in range(n):
            pages.append((at, f"https://{host}/en/{j}", "h", "x", "x"))
            at += 1
    first = {}
    labels = []
    for i, u, *_ in pages[len(odd) :]:
        h = split(u)[0]
        j = first[h] = first.get(h, -1) + 1
        bad = j < {"bad.spam.net": 58, "new.spam.net": 3, "fine.net": 4, "one.fine.com": 1, "big.com": 90, "www.worse.co.uk": 39}[h]
        labels.append((i, int(not bad), 0, 1) if j % 2 else (i, None, int(bad), 1))
    labels += [(5, 1, None, 1), (5, 1, 1, 1), (6, None, None, 1), (None, 0, 1, 1), (10**9, 0, 1, 1), labels[0]]
    pages += [pages[-1], (None, "https://fine.net/z", "h", "x", "x"), (None, "https://fine.net/z", "h", "x", "x")]
    return pages, labels


def test_brute_force(spark):
    pages, labels = fixture()
    got = uf.report(spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = brute(pages, labels)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    verdict = {r.host: r.verdict for r in got if r.rule is None}
    assert verdict["bad.spam.net"] == "block" and verdict["www.worse.co.uk"] == "block"
    assert verdict["fine.net"] == verdict["one.fine.com"] == verdict["big.com"] == "allow"
    bound = {r.host: r.bad_bound for r in got}
    assert bound["new.spam.net"] > bound["one.fine.com"]  # it shares a domain with a bad host


def test_without_labels_and_empty(spark):
    pages, _ = fixture()
    none = spark.createDataFrame([], LABELS)
    got = uf.report(spark.createDataFrame(pages, PAGES), none).collect()
    assert len(got) == len(pages) and {r.verdict for r in got if r.rule is None} == {"allow"}
    assert uf.report(spark.createDataFrame([], PAGES), none).collect() == []
