from lumentrace.llm import url_filters as U


def brute_spread(edges, allowed, blocked):
    out, into = {}, {}
    for (s, d), w in edges.items():
        out[s] = out.get(s, 0) + w
        into[d] = into.get(d, 0) + w
    scores = []
    for seeds, flow in ((allowed, [(s, d, w, out[s]) for (s, d), w in edges.items()]), (blocked, [(d, s, w, into[d]) for (s, d), w in edges.items()])):
        base = {h: n * U.UNIT for h, n in seeds.items() if n}
        now = dict(base)
        for _ in range(U.ROUNDS):
            new = {h: x * (100 - U.DAMPING_PERCENT) // 100 for h, x in base.items()}
            for s, d, w, total in flow:
                if s in now:
                    new[d] = new.get(d, 0) + now[s] * w // total * U.DAMPING_PERCENT // 100
            now = new
        scores.append(now)
    return scores


def link(*hosts):
    return "".join(f'<a class=x href="https://{h}/p">x</a>' for h in hosts) + '<a href="/own">y</a><A HREF=\'//cdn.other.com/q?x\'>z</A>'


PAGES = [
    (1, "https://Good.Example.NET/de/1?x", link("friend.site.org", "friend.site.org", "far.site.org")),
    (2, "http://friend.site.org/fr/2#t", link("far.site.org")),
    (3, "http://bad.example.com/en/8", None), (4, "http://farm.spam.biz/x", link("bad.example.com")), (5, "http://farm.spam.biz", ""),
    (6, None, link("bad.example.com")), (7, "no scheme", "<p>"), (8, "ftp://example.com/en/77", ""), (9, "http://a.example.net/de/8x", ""),
    (10, "http://com/en/", ""), (11, "http://com.evil/en/", ""), (12, "http://x.org/es/?q=http://y.com/en/", ""), (13, "://h/en", ""), (14, "a://b://c.com/en/", ""),
    (15, "http://friend.site.org/fr/2#t", link("far.site.org")), (15, "http://friend.site.org/fr/2#t", link("far.site.org")), (None, "http://sub.com/en/1", None),
]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[at:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path[:end]


def rule_of(host, path):
    best = (None, None)
    for verdict, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def test_small_graph(spark):
    import re

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    edges, allowed, blocked, hosts = {}, {}, {}, {host_path(u)[0] for _, u, _ in PAGES}
    for _, url, html in PAGES:
        host, path = host_path(url)
        for target in {m[0] for m in re.findall(r"""(?i)href\s*=\s*["']?((https?:)?//[^"'\s>]+)""", html or "")}:
            to = re.match(r"(?:[^/]*:)?//([^/?#]*)", target)[1].lower()
            if host and to and host != to:
                edges[(host, to)] = edges.get((host, to), 0) + 1
        verdict = rule_of(host, path)[1]
        if host:
            for seeds, v in ((allowed, "allow"), (blocked, "block")):
                seeds[host] = seeds.get(host, 0) + (verdict == v)
    for host in hosts:
        up = host.partition(".")[2]
        if "." in up:
            edges[(host, up)] = edges.get((host, up), 0) + 1
            edges[(up, host)] = edges.get((up, host), 0) + 1
    trust, distrust = brute_spread(edges, allowed, blocked)
    rows = U.judged(df).collect()
    assert len(rows) == len(PAGES)
    want = []
    for page, url, _ in PAGES:
        host, path = host_path(url)
        rule, verdict = rule_of(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        outweighs = 100 * d * sum(allowed.values()) > U.THRESHOLD_PERCENT * t * sum(blocked.values())
        want.append((page or -1, host, path, rule or "", verdict or ("block" if outweighs else "allow"), str(t), str(d)))
    assert sorted((r[0] or -1, r[1], r[2], r[3] or "", r[4], r[5], r[6]) for r in rows) == sorted(want)
    found = {r["page_id"]: r for r in rows}
    assert found[4]["verdict"] == "block" and found[4]["rule"] is None and found[2]["verdict"] == "allow" and int(found[2]["trust"]) > 0


def test_empty(spark, nothing):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judged(empty).count() == 0
    no_rules = spark.createDataFrame([(1, "http://plain.site/x", None)], "page_id long, url string, html string")
    (row,) = U.judged(no_rules).collect()
    assert (row["verdict"], row["trust"], row["distrust"]) == ("allow", "0", "0")


def test_odd_pages(spark):
    """Clashing extra columns, and very long html with a link at its end."""
    html = "<p>x</p>" * 300_000 + link("bad.example.com")
    rows = [(1, "http://bad.example.com/en/8", None), (2, "http://farm.spam.biz/x", html)]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], "page_id long, url string, html string, host string, score int, w int, total int")
    found = {r["page_id"]: r["verdict"] for r in U.judged(df).collect()}
    assert found == {1: "block", 2: "block"}


def test_size_changes_no_rule(spark):
    """999, 1,000 and 1,001 links of a host, and one or a million seed pages: shares differ by the links only."""
    for n in (999, 1000, 1001):
        edges = [("hub", f"t{i}.x", 1) for i in range(n)]
        seeds = spark.createDataFrame([("hub", 1, 0)], "host string, allowed long, blocked long")
        got = {r["host"]: int(r["trust"]) for r in U.spread(spark.createDataFrame(edges, "src string, dst string, w long"), seeds).collect()}
        assert got["t0.x"] == U.UNIT * (100 - U.DAMPING_PERCENT) // 100 // n * U.DAMPING_PERCENT // 100
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 49), ("b", "d", 1), ("b", "e", 49)], "src string, dst string, w long")
    scores = []
    for n in (1, 10**6):
        seeds = spark.createDataFrame([("a", n, 0)], "host string, allowed long, blocked long")
        scores.append({r["host"]: int(r["trust"]) for r in U.spread(edges, seeds).collect()})
    assert all(abs(scores[1][h] - 10**6 * scores[0][h]) <= 10**6 * U.ROUNDS for h in "abcde") and scores[0]["d"] > 10**7
    many = spark.range(10**6).selectExpr("concat('s', id) AS host", "1L AS allowed", "0L AS blocked")
    links = spark.range(1).selectExpr("'s7' AS src", "'far' AS dst", "1L AS w").unionByName(spark.createDataFrame([("far", "farther", 1)], "src string, dst string, w long"))
    got = {r["host"]: int(r["trust"]) for r in U.spread(links, many).filter("host IN ('far', 'farther')").collect()}
    assert got["farther"] > U.UNIT // 20


def test_hub_with_more_links_than_shares(spark):
    edges = [("hub", "a.x", 1), ("hub", "b.x", 2_999_999), ("farm", "bad", 1), ("others", "bad", 2_999_999)]
    seeds = spark.createDataFrame([("hub", 1, 0), ("bad", 0, 1)], "host string, allowed long, blocked long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in U.spread(spark.createDataFrame(edges, "src string, dst string, w long"), seeds).collect()}
    kept = U.UNIT * (100 - U.DAMPING_PERCENT) // 100
    part = lambda w: kept * w // 3_000_000 * U.DAMPING_PERCENT // 100
    got = {h: (int(t), int(d)) for h, (t, d) in got.items()}
    assert got["a.x"] == (part(1), 0) and got["b.x"] == (part(2_999_999), 0) and part(1) > 0
    assert got["farm"] == (0, part(1)) and got["others"] == (0, part(2_999_999))
