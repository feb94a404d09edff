"""Operator 10 on a generated host graph in which one host takes a third of all links."""

import collections
import random

import pytest

from spendlake.llm import urls

SETTINGS = urls.LinkSettings()


def plain_scores(hosts, edges, seed):
    """Personalised PageRank by plain rounds until nothing changes any more."""
    d = SETTINGS.damping
    out = collections.Counter()
    for (a, _), n in edges.items():
        out[a] += n
    score = {h: (1 - d) * seed.get(h, 0) for h in hosts}
    for _ in range(200):
        new = {h: (1 - d) * seed.get(h, 0) for h in hosts}
        for (a, b), n in edges.items():
            new[b] += d * score[a] * n / out[a]
        score = new
    return score


@pytest.mark.parametrize("seed", [3])
def test_hot_host_graph_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    names = [f"h{i}.{rng.choice(['com', 'com', 'net', 'org', 'info'])}" for i in range(120)]
    hub, farm = "hub.com", [f"farm{i}.info" for i in range(12)]
    blocked = [x for x in names if x.endswith(".net")]
    rows, edges, pages = [], collections.Counter(), collections.Counter()
    rules = collections.defaultdict(collections.Counter)
    for i in range(900):
        host = rng.choice([hub, *farm, *names]) if i % 10 else hub
        path = rng.choice(["/fr/a", "/en/b", "/"])
        if host in farm:
            targets = rng.choices(blocked, k=3)
        else:
            targets = [hub if rng.random() < 0.33 else rng.choice(names) for _ in range(rng.randrange(5))]
        links = "".join(f"<a href='https://{x}/p'>x</a>" for x in targets)
        rows.append((i, f"http://{host}{path}", links + "<a href='/local'>y</a>"))
        for x in set(targets) - {host}:
            edges[host, x] += 1
        pages[host] += 1
        verdict = "block" if host.endswith(".net") else "allow" if host.endswith(".org") and path.startswith("/fr/") else None
        rules[verdict][host] += 1
    hosts = {hub, *farm, *names}
    share = {v: {h: n / pages[h] for h, n in rules[v].items()} for v in ("allow", "block")}
    trust = plain_scores(hosts, edges, share["allow"])
    distrust = plain_scores(hosts, collections.Counter({(b, a): n for (a, b), n in edges.items()}), share["block"])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = urls.url_verdicts(df).collect()
    assert len(got) == 900 and max(n for (_, b), n in edges.items() if b == hub) > 1
    seen = set()
    for r in got:
        assert abs(r.trust - trust[r.host]) < 1e-5 and abs(r.distrust - distrust[r.host]) < 1e-5
        gap = distrust[r.host] - trust[r.host] - SETTINGS.threshold * (1 - SETTINGS.damping)
        if r.rule is None and abs(gap) > 1e-4:
            assert r.verdict == ("block" if gap > 0 else "allow"), r
            seen.add((r.host in farm, r.verdict))
    assert (True, "block") in seen and (False, "allow") in seen
