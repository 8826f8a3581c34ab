"""URL filters: host and path rules, and trust propagated over the host graph for the rest.

Rules fit a host and its subdomains, and urls whose path starts with the rule's; the longest wins. The
hosts whose urls rules allow are the trusted seeds, those whose urls rules block are the blocked ones, UNIT for each
such url. Trust is the personalised PageRank from the trusted seeds along the links between hosts; distrust is that
from the blocked seeds along the reversed links: who links to a bad host is suspect. A host that has no links to
pass its rank along keeps it, as if it linked to itself, so no rank is lost. Rounds go on until a round moves less than
``tolerance`` of all rank; damping bounds their number.

A host is blocked if its distrust is at least ``least`` of a blocked url's UNIT, and more than ``factor`` times its
trust. Neither depends on how large the table is.

Ranks are integers: sums then do not depend on the order in which the cluster adds. Links are counted by pair of
hosts before they are shuffled, so one host with very many pages is one row of each neighbour. Pages meet the
ranks of their hosts by broadcast if those are few, else each host in ``SALTS`` parts, so that one host's pages are spread.

Defined cases: a null url or one without ``://`` has an empty host and path, is nobody's seed, has no
links, and is allowed; null html has no links; a link without a host is one to the page's own host, one of another scheme
without ``//`` (mail, script) is none; equally long rules are told apart by text; rows that repeat are judged alike and
count as often as they come; empty tables give no rows; columns named like a result's are replaced, others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

UNIT = 100_000_000
SALTS = 32
MAX_BROADCAST = 1_000_000
#: A link's target with its quotes, if any.
HREF = r"""(?is)<(?:a|area)\s(?:[^<>]*?\s)?href\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
ABSOLUTE = r"""^["']?\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s"']*)"""
SCHEME = r"""^["']?\s*[A-Za-z][A-Za-z0-9+.\-]*:"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """``(text, verdict)`` of the longest rule that fits, else null; of equally long ones the first by text."""
    best = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*best)


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, links`` of the pages ``(host, html)``."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    to = pages.filter("host <> ''").select("host", F.explode(links).alias("href"))
    to = to.select("host", F.regexp_extract("href", ABSOLUTE, 1).alias("abs"), F.col("href").rlike(SCHEME).alias("scheme")).filter("abs <> '' or not scheme")
    return to.select(F.col("host").alias("src"), F.when(F.col("abs") != "", ascii_lower(F.col("abs"))).otherwise(F.col("host")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, every: int = 4) -> DataFrame:
    """``host, trust, distrust`` from seeds ``(host, allowed, blocked)``; looked at for convergence ``every`` so many rounds."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    reverse = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    ways = cut(forward.unionByName(reverse))
    start = cut(
        seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("n")))).alias("x"))
        .filter("x.n > 0").select("x.kind", "host", (F.col("x.n") * UNIT).alias("mass"))
    )
    again = start.select("kind", "host", F.floor(F.col("mass") * F.lit(1 - damping)).alias("mass"))
    rank = start
    for k in range(math.ceil(math.log(tolerance) / math.log(damping))):  # as many rounds as the tolerance can take
        before = rank
        moved = rank.join(ways, ["kind", "host"], "left").select("kind", F.coalesce("to", "host").alias("host"), F.floor(F.col("mass") * F.coalesce("share", F.lit(1.0)) * F.lit(damping)).alias("mass"))
        rank = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % every == every - 2:
            rank = cut(rank)
        elif k % every == every - 1:
            rank = cut(rank)
            both = rank.unionByName(before.withColumn("mass", -F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("change"), F.sum(F.greatest("mass", F.lit(0))).alias("mass"))
            change, mass = both.agg(F.sum(F.abs("change")), F.sum("mass")).first()
            if (change or 0) <= tolerance * (mass or 0):
                break
    ranks = [F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind) for kind in ("trust", "distrust")]
    return rank.groupBy("host").agg(*ranks)


def judged(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-4, least: float = 1e-6, factor: float = 1.0,
    url_col: str = "url", html_col: str = "html", max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``pages`` without its html, with ``host, path, rule, verdict, trust, distrust``."""
    rest = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict", "trust", "distrust")]
    own = pages.select(*rest, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(html_col).alias("__html"))
    own = own.withColumn("__rule", rule(rules, F.col("host"), F.col("path")))
    edges = cut(host_edges(own.select("host", F.col("__html").alias("html"))))
    count = [F.count(F.when(F.col("__rule.verdict") == v, 1)).alias(n) for v, n in (("allow", "allowed"), ("block", "blocked"))]
    seeds = cut(own.filter("__rule is not null and host <> ''").groupBy("host").agg(*count))
    ranks = cut(propagate(edges, seeds, damping, tolerance).select(F.col("host").alias("__host"), F.col("trust").alias("__trust"), F.col("distrust").alias("__distrust")))
    own = own.drop("__html")
    if ranks.count() <= max_broadcast:
        joined = own.join(F.broadcast(ranks), F.col("host") == F.col("__host"), "left")
    else:
        own = own.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
        ranks = ranks.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.join(ranks, (F.col("host") == F.col("__host")) & (F.col("__salt") == F.col("__part")), "left")
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("__trust", "__distrust"))
    method = F.when((distrust >= int(least * UNIT)) & (distrust > trust * factor), "block").otherwise("allow")
    return joined.select(*rest, "host", "path", F.col("__rule.text").alias("rule"), F.coalesce("__rule.verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def rule_sql(rules: tuple[Rule, ...], field: str) -> str:
    """The ``text`` or ``verdict`` of the longest fitting rule as SQL over ``host`` and ``path``."""
    cases = [
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, field)}'"
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return "case " + " ".join(cases) + " end"


def sql(rules: tuple[Rule, ...] = RULES, damping: float = 0.85, rounds: int = 12, least: float = 1e-6, factor: float = 1.0) -> str:
    """The same judgement in DuckDB SQL over ``pages``, with that many rounds unrolled instead of a test of convergence."""
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    step = "\n".join(
        f""", r{k + 1} as materialized (
  select kind, host, cast(sum(mass) as bigint) as mass from (
    select r.kind, coalesce(w.dest, r.host) as host, cast(floor(cast(r.mass as double) * coalesce(w.share, 1.0::double) * {damping!r}::double) as bigint) as mass from r{k} r left join ways w on r.kind = w.kind and r.host = w.host
    union all select kind, host, cast(floor(cast(mass as double) * {1 - damping!r}::double) as bigint) from r0
  ) group by kind, host
)"""
        for k in range(rounds)
    )
    return rf"""
with u as (
  select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {upper}) as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), p as (
  select page_id, html, host, path, {rule_sql(rules, "text")} as rule, {rule_sql(rules, "verdict")} as ruled from u
), link as (
  select host as src, unnest(regexp_extract_all(coalesce(html, ''), {quoted(HREF)}, 1)) as href from p where host <> ''
), edge as (
  select src, case when abs_host <> '' then translate(abs_host, {upper}) else src end as dst, count(*) as links
  from (select src, regexp_extract(href, {quoted(ABSOLUTE)}, 1) as abs_host, regexp_matches(href, {quoted(SCHEME)}) as scheme from link) where abs_host <> '' or not scheme group by all
), ways as materialized (
  select 'trust' as kind, src as host, dst as dest, cast(links as double) / cast(sum(links) over (partition by src) as double) as share from edge
  union all select 'distrust', dst, src, cast(links as double) / cast(sum(links) over (partition by dst) as double) from edge
), seed as (
  select host, count(*) filter (ruled = 'allow') as allowed, count(*) filter (ruled = 'block') as blocked from p where ruled is not null and host <> '' group by host
), r0 as materialized (
  select 'trust' as kind, host, cast(allowed * {UNIT} as bigint) as mass from seed where allowed > 0
  union all select 'distrust', host, cast(blocked * {UNIT} as bigint) from seed where blocked > 0
){step}, ranks as (
  select host, sum(case when kind = 'trust' then mass else 0 end) as trust, sum(case when kind = 'distrust' then mass else 0 end) as distrust from r{rounds} group by host
)
select page_id, p.host, path, rule, coalesce(ruled, case when coalesce(distrust, 0) >= {int(least * UNIT)} and coalesce(distrust, 0) > coalesce(trust, 0) * {factor!r} then 'block' else 'allow' end) as verdict
from p left join ranks on p.host = ranks.host
"""


__all__ = ["RULES", "Rule", "host", "host_edges", "judged", "path", "propagate", "rule", "sql"]
