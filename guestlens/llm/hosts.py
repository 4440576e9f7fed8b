"""URL verdicts: rules first, else trust and distrust spread over the links of hosts."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.session import stage

# (host, path, verdict) of the rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Chance of following a link; share of a host's walk that must come from blocked pages.
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-3
_ROUNDS = 100

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# An anchor up to its href: whole attributes one by one, so that a value that looks like
# one is skipped. Nothing is tried twice and no tag is left, whatever stands in a page.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'<>][^\s<>]*))"""
_OTHER = r"""(?:\s+(?!href\s*=)[^\s=<>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s<>]*))?)*+"""
_ANCHOR = rf"(?is)<a{_OTHER}\s+href\s*=\s*{_VALUE}"
_ABSOLUTE = r"(?is)^\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\s]+)"


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # tried from the longest; of equally long ones the smaller text first
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        one = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, one).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. `pages` (host, html)."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_ANCHOR), F.lit(0))
    targets = F.transform(
        tags,
        lambda t: _lower(F.regexp_extract(F.concat_ws("", *(F.regexp_extract(t, _ANCHOR, i) for i in (1, 2, 3))), _ABSOLUTE, 1)),
    )
    # relative links stay on the host and say nothing about others
    away = F.filter(targets, lambda t: (t != "") & (t != F.col("host")))
    links = pages.select(F.col("host").alias("src"), F.explode(away).alias("dst"))
    return links.where(F.col("src") != "").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread_trust(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, weight) of every host.

    Three personalised PageRank vectors at once. Trust starts at the pages that a rule
    allows and follows the links, distrust starts at the pages that a rule blocks and
    follows the links backwards, weight starts at all pages and follows the links. The
    walk that a host without links would go on is lost. One join of the links with the
    ranks per direction and one combining sum by host make a round; rounds end when no
    value moves by more than `tolerance` of itself.

    seeds: (host, allowed, blocked, pages) counts of pages.
    """
    links = stage(links, "host-links")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = stage(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("part")), "forward")
    backward = stage(links.join(into, "dst").select("src", "dst", (F.col("n") / F.col("total")).alias("part")), "backward")
    nodes = links.select(F.col("src").alias("host")).union(links.select("dst")).union(seeds.select("host")).distinct()
    start = {"trust": "allowed", "distrust": "blocked", "weight": "pages"}
    nodes = nodes.join(seeds, "host", "left").select(
        "host", *(((1 - damping) * F.coalesce(F.col(c), F.lit(0))).alias(f"{n}_0") for n, c in start.items())
    )
    nodes = stage(nodes, "hosts")
    ranks = nodes.select("*", *(F.col(f"{n}_0").alias(n) for n in start))
    if links.isEmpty():
        return ranks.select("host", *start)
    for _ in range(_ROUNDS):
        part = lambda c: (F.col("part") * F.col(c) * damping).alias(c)
        nothing = lambda c: F.lit(0.0).alias(c)
        ahead = forward.join(ranks, forward["src"] == ranks["host"])
        ahead = ahead.select(F.col("dst").alias("host"), part("trust"), nothing("distrust"), part("weight"))
        back = backward.join(ranks, backward["dst"] == ranks["host"])
        back = back.select(F.col("src").alias("host"), nothing("trust"), part("distrust"), nothing("weight"))
        came = ahead.unionByName(back).groupBy("host").agg(*(F.sum(n).alias(f"{n}_in") for n in start))
        now = ranks.join(came, "host", "left")
        value = {n: F.col(f"{n}_0") + F.coalesce(F.col(f"{n}_in"), F.lit(0.0)) for n in start}
        moved = F.greatest(*(F.abs(v - F.col(n)) - tolerance * v for n, v in value.items()))
        now = now.select("host", *(f"{n}_0" for n in start), *(v.alias(n) for n, v in value.items()), moved.alias("moved"))
        now = stage(now, "ranks")
        ranks = now.drop("moved")
        if now.agg(F.max("moved")).first()[0] <= 0:
            break
    else:
        raise RuntimeError(f"the ranks have not settled in {_ROUNDS} rounds")
    return ranks.select("host", *start)


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    The longest rule that fits decides. Without one, the page's host decides: it is
    blocked when its distrust exceeds both its trust and `threshold` of its weight
    (`spread_trust`), so a host of which a smaller part is blocked stays allowed.

    A null url, or one without "://", has empty host and path, fits no rule and is
    allowed. A null html has no links. Repeated rows count as pages of their own. An empty
    table gives no rows. Columns of other names are not looked at.
    """
    urls = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html")
    )
    ruled = urls.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("_rule.verdict")
    seeds = ruled.where(F.col("host") != "").groupBy("host").agg(
        F.count_if(verdict == "allow").alias("allowed"),
        F.count_if(verdict == "block").alias("blocked"),
        F.count(F.lit(1)).alias("pages"),
    )
    hosts = spread_trust(stage(seeds, "seeds"), host_links(urls), damping)
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * F.col("weight"))
    hosts = stage(hosts.withColumn("_verdict", F.when(blocked, "block").otherwise("allow")), "verdicts")
    return ruled.drop("html").join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(verdict, F.col("_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
