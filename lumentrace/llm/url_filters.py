"""URL filters: host rules, then trust and distrust that spread over the graph of hosts.

Trust is a personalised PageRank from hosts with allowed pages along links; distrust starts at hosts with
blocked pages and runs against the links, from a blocked host to those that point at it. A host where
distrust outweighs trust is blocked. Scores are whole numbers, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import join_facts, lower_ascii, written

#: (verdict, host and path); a rule fits its host and every subdomain.
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)
ROUNDS = 10
DAMPING_PERCENT = 85
#: What every seed page brings; scores are whole numbers of up to 38 digits.
UNIT = 10**12
SCORE = "decimal(38,0)"
#: A host is blocked when 100 * distrust / blocked pages > THRESHOLD_PERCENT * trust / allowed pages (of all hosts).
THRESHOLD_PERCENT = 100
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and the domains above it, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules): the rules that fit each host, as structs (rank, path, rule, verdict)."""
    rows = [(r[: r.find("/")] if "/" in r else r, r[r.find("/") :] if "/" in r else "", r, v) for v, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "suffix string, path string, rule string, verdict string")
    found = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("suffix"))
    return (
        join_facts(found, table, len(rows), ["suffix"], "inner").groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct(F.char_length("rule").alias("rank"), "path", "rule", "verdict")), False).alias("rules"))
    )


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w) between different hosts: absolute links in the pages, counted, and each host with its parent domain.

    Counts are summed before the shuffle. A parent of a single label (``com``) is no host.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))))
    links = pages.filter(F.col("html").rlike(LINK)).select("host", found.alias("to")).select(
        F.col("host").alias("src"), lower_ascii(F.regexp_extract("to", r"^(?:[^/]*:)?//([^/?#]*)", 1)).alias("dst")
    )
    parent = F.substring_index(F.col("host"), ".", -1)
    above = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up")).filter(
        F.col("host").contains(".") & F.col("up").contains(".") & (F.col("up") != parent)
    )
    family = above.select(F.explode(F.array(
        F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst"))
    )).alias("e")).select("e.*")
    both = links.unionByName(family).filter("src <> '' AND dst <> '' AND src <> dst")
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def _whole(over: Column, under: Column) -> Column:
    """Quotient of whole numbers without its fraction, in 38 digits."""
    return ((over - over % under) / under).cast(SCORE)


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, w) and seeds (host, allowed, blocked counts).

    Every seed page brings UNIT parts, however many seeds there are, and every link of a host moves its share of what the
    host has, however many links it has; only the fraction of one part is lost in a step.
    Without seeds of a kind its scores are 0. A host without links keeps only its seed share.
    """
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("total"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("w").alias("total"))
    along = edges.join(out, edges.src == out.host).select("src", "dst", F.lit(0).alias("kind"), "w", "total")
    against = edges.join(into, edges.dst == into.host).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("kind"), "w", "total"
    )
    flow = written(along.unionByName(against), "flow")
    count = F.when(F.col("kind") == 0, F.col("allowed")).otherwise(F.col("blocked")).cast("decimal(18,0)")
    base = seeds.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "host", "kind", (count * F.lit(UNIT).cast("decimal(13,0)")).cast(SCORE).alias("score")
    ).filter("score > 0")
    base = written(base, "seeds")
    hundred, damping = F.lit(100).cast("decimal(3,0)"), F.lit(DAMPING_PERCENT).cast("decimal(3,0)")
    kept = base.select("host", "kind", _whole(F.col("score") * (hundred - damping), hundred).alias("score"))
    now = base
    for i in range(rounds):
        share = _whole(F.col("score").cast("decimal(26,0)") * F.col("w").cast("decimal(11,0)"), F.col("total").cast("decimal(20,0)"))
        moved = now.withColumnRenamed("host", "src").join(flow, ["src", "kind"]).select(
            F.col("dst").alias("host"), "kind", _whole(share * damping, hundred).alias("score")
        )
        now = kept.unionByName(moved).groupBy("host", "kind").agg(F.sum("score").cast(SCORE).alias("score"))
        if i % 5 == 4:
            now = written(now, "scores")
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).cast(SCORE)
    return now.groupBy("host").agg(pick(0).alias("trust"), pick(1).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    The longest rule that fits host and path decides; where none fits, the host's scores do, and a host
    without scores (or an empty one) is allowed. A null url, or one without ``://``, has empty host and path.
    Repeated rows get equal verdicts and count as pages of their own; an empty table gives an empty result;
    null html has no links; other columns are not read. trust and distrust are the scores' digits as text.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    hosts = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select("host"), "hosts")
    n = hosts.count()
    fitting = written(host_rules(hosts, rules), "rules")
    first = lambda part: F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))[part]
    ruled = join_facts(rows.drop("html"), fitting, n, ["host"])
    marked = written(ruled.select("page_id", "host", "path", first("rule").alias("rule"), first("verdict").alias("ruled")), "ruled")
    seeds = marked.groupBy("host").agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    ).filter("host <> ''")
    scores = written(spread(written(host_edges(rows, hosts), "links"), seeds), "hostscores")
    facts = hosts.join(scores, "host")
    joined = join_facts(marked, facts, n, ["host"])
    trust, distrust = (F.coalesce(c, F.lit(0).cast(SCORE)).cast("decimal(24,0)") for c in ("trust", "distrust"))
    # shares of all seeds of a kind, compared without a division; without seeds of a kind its scores are 0
    allowed, blocked = (seeds.agg(F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)).cast("decimal(11,0)")).scalar() for c in ("allowed", "blocked"))
    outweighs = F.lit(100).cast("decimal(3,0)") * (distrust * allowed) > F.lit(THRESHOLD_PERCENT).cast("decimal(3,0)") * (trust * blocked)
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(outweighs, "block").otherwise("allow")).alias("verdict"),
        trust.cast("string").alias("trust"), distrust.cast("string").alias("distrust"),
    )
