"""Lists of many shapes: planned and judged in bounded time, and as plain matching says."""

import random
import time

from tidepost.llm import urls


def plain(url, rules):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host, path = rest, ""
    for i, c in enumerate(rest):
        if c in "/?#":
            host, path = rest[:i], rest[i:].split("?")[0].split("#")[0]
            break
    host = host.lower()
    fits = [(len(h) + len(p), len(h), h, p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2] + max(fits)[3]) if fits else None


def test_ten_thousand_entries_of_many_shapes(spark):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rules = {(rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 300)))) for _ in range(10_000)}
    rules = [(h, p, "block") for h, p in sorted(rules)] + [("net", "", "allow"), ("", "/only", "block")]
    tried = [f"http://{h}{p}{rng.choice(['', '/z', '?q', '#f'])}" for h, p, _ in rng.sample(rules, 150)]
    tried += [f"http://w.{rng.choice(hosts)}/xy/{i}" for i in range(50)] + ["http://NET", "http:///only", "x", "http://"]
    pages = spark.createDataFrame(list(enumerate(tried)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    start = time.time()
    found = {r.page_id: r.rule for r in urls.url_verdicts(pages, listed).collect()}
    assert time.time() - start < 60
    assert found == {i: plain(u, rules) for i, u in enumerate(tried)}
