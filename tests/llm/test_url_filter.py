import random
import re

import numpy as np

from revlens.llm import url_filter as u

from .helpers import rows_of


def brute(rows):
    cut = []
    for i, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        cut.append((i, host, path, *(max(fit)[1:] if fit else (None, None))))
    votes = {}
    for _, host, _, _, v in cut:
        votes[host] = votes.get(host, 0) + {"block": 1, "allow": -1, None: 0}[v]
    return sorted(((i, h, p, r, v or ("block" if votes[h] > 0 else "allow")) for i, h, p, r, v in cut), key=str)


def urls():
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "no scheme.org/"), (4, "http://"), (5, "http://ORG"), (6, "HTTP://A.Example.ORG/es/x"),
            (7, "https://example.org/en/12?q#f"), (8, "x://badexample.org/es/"), (9, "http://É.com/de/"), (None, "http://a.com/de/"),
            (10, "http://a.com?x=/de/"), (11, "http://a.com#/fr/"), (11, "http://a.com/fr"), (12, "a://b://c.com/de/")]
    for i in range(20, 3000):
        rows.append((i, f"http://h{rng.randrange(700)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{i}"))
    return rows


def test_against_brute_force_both_ways(spark):
    rows = urls()
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    want = brute(rows)
    assert sorted(map(tuple, u.filter_urls(df).collect()), key=str) == want
    assert sorted(map(tuple, u.filter_urls(df, max_broadcast_bytes=-1).collect()), key=str) == want


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(0)
    for n, share in ((1, 1.0), (1, 0.0), (5000, 0.02), (5000, 0.5), (5000, 0.97), (300, 1.0), (300, 0.0)):
        h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        listed = rng.random(n) < share
        made = u.build_levels(h1, h2, listed)
        cascade = u.Cascade([{"shard": 0, "level": k + 1, "bits": b, "hashes": h, "words": w}
                             for k, (b, h, w) in enumerate(made)], 1)
        assert (cascade.contains(h1, h2) == listed).all()


def test_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(none).count() == 0
    odd = spark.createDataFrame([(1, "http://x.org/a", "h", "p", True, 5)],
                                "page_id long, url string, host string, path string, listed boolean, id int")
    assert rows_of(u.filter_urls(odd)) == {(1, "x.org", "/a", "org/", "allow"): 1}
