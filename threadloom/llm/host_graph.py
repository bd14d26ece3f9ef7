"""URL filter: rules by host and path, and trust that spreads over the host graph.

Personalised PageRank carries trust from hosts of allowed pages along links, and distrust from
hosts of blocked pages against them (who links to a blocked host is suspect). Both run in one
loop over (kind, from, to, weight) edges, with DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, host, path) rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. The suffixes of the
    host look their rules up in a literal map, so a url meets the rules of its own domains only.
    Of two rules that spell the same, a block wins.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entries = []
    for h, found in by_host.items():
        each = [F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"),
                         F.lit(p).alias("path")) for p, v in found]
        entries += [F.lit(h), F.array(*each)]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()))
    best = F.array_max(F.filter(fits, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) links between different hosts, from the absolute links of each page."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(
        F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and dst <> src").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(host, trust, distrust) after `rounds` of personalised PageRank from `seeds` (host, trust, distrust).

    Trust flows src to dst, split over a host's links; distrust flows dst to src, split over the
    hosts that link there. Mass at a host without such links is not spread again. Every round is
    stored: its sizes are known to the planner, which then may split the links of a hub.
    """
    seeds = kept(seeds, "seeds")
    edges = kept(edges, "edges")
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("here"), F.col("dst").alias("there"))
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("here"), F.col("src").alias("there"))
    both = forward.unionByName(backward)
    degree = both.groupBy("kind", "here").agg(F.count(F.lit(1)).alias("degree"))
    flow = kept(both.join(kept(degree, "degree"), ["kind", "here"]).select(
        "kind", "here", "there", (F.lit(damping) / F.col("degree")).alias("weight")), "flow")
    base = kept(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "mass")).filter(
        "mass > 0").select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass")), "base")
    rank = base
    if not flow.isEmpty():
        for step in range(rounds):
            moved = rank.join(flow, (rank.kind == flow.kind) & (rank.host == flow.here)).select(
                flow.kind, F.col("there").alias("host"), (F.col("mass") * F.col("weight")).alias("mass"))
            rank = kept(base.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), f"rank{step}")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    return rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 10,
               threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Seeds are the shares of a host's pages that a rule allows or blocks; the share that no rule
    covers stays neutral. Where no rule fits a url, its host is blocked if distrust exceeds
    `threshold` of trust, distrust and neutral mass together. A null url has an empty host and
    path, no rule, and is allowed; a null html has no links; repeated pages count again; other
    columns are ignored.
    """
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parsed.withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("by_rule"))
    judged = kept(judged, "judged")
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    shares = kept(judged.filter("host <> ''").groupBy("host").agg(
        one(F.col("by_rule") == "allow").alias("trust"), one(F.col("by_rule") == "block").alias("distrust"),
        one(F.col("by_rule").isNull()).alias("neutral")), "shares")
    ranks = propagate(host_edges(pages), shares, damping, rounds)
    neutral = F.coalesce(F.col("neutral"), F.lit(0.0)) * (1 - damping)
    suspect = ranks.join(shares.select("host", "neutral"), "host", "left").filter(
        F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + neutral)).select("host", F.lit(True).alias("_bad"))
    verdict = F.coalesce("by_rule", F.when(F.col("_bad"), "block").otherwise("allow"))
    return judged.join(kept(suspect, "suspect"), "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"))


def judge_urls_sql(rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int = 10, threshold: float = 0.5) -> str:
    """The same as one SQL text: the rounds are written out one by one."""
    listed = ", ".join(f"('{v}', '{h}', '{p}', {len(h + p)})" for v, h, p in rules)
    link = LINK.replace("'", "''")
    steps, rank = [], "base"
    for i in range(rounds):
        steps.append(f"""rank{i} AS (SELECT kind, host, sum(mass) AS mass FROM (SELECT * FROM base UNION ALL
 SELECT f.kind, f.there, r.mass * f.weight FROM {rank} r JOIN flow f ON r.kind = f.kind AND r.host = f.here) GROUP BY ALL)""")
        rank = f"rank{i}"
    return f"""
WITH rules(verdict, rhost, rpath, size) AS (VALUES {listed}),
p AS (SELECT row_number() OVER () AS n, page_id, html, lower(coalesce(regexp_extract(url, '{URL}', 1), '')) AS host,
 coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
m AS (SELECT n, arg_max(rhost || rpath, struct_pack(size := size, verdict := rules.verdict)) AS rule,
 arg_max(rules.verdict, struct_pack(size := size, verdict := rules.verdict)) AS by_rule
 FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n),
j AS (SELECT p.*, rule, by_rule FROM p LEFT JOIN m USING (n)),
shares AS (SELECT host, avg((by_rule IS NOT DISTINCT FROM 'allow')::INT) AS trust,
 avg((by_rule IS NOT DISTINCT FROM 'block')::INT) AS distrust, avg((by_rule IS NULL)::INT) AS neutral FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT DISTINCT host AS src, lower(unnest(regexp_extract_all(html, '{link}', 1))) AS dst FROM p WHERE host <> ''),
edges AS (SELECT 'trust' AS kind, src AS here, dst AS there FROM links WHERE src <> dst
 UNION ALL SELECT 'distrust', dst, src FROM links WHERE src <> dst),
flow AS (SELECT *, {damping} / count(*) OVER (PARTITION BY kind, here) AS weight FROM edges),
base AS (SELECT 'trust' AS kind, host, trust * {1 - damping!r} AS mass FROM shares WHERE trust > 0
 UNION ALL SELECT 'distrust', host, distrust * {1 - damping!r} FROM shares WHERE distrust > 0),
{", ".join(steps)},
t AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust,
 sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM {rank} GROUP BY host),
bad AS (SELECT t.host FROM t LEFT JOIN shares s USING (host)
 WHERE t.distrust > {threshold} * (t.trust + t.distrust + coalesce(s.neutral, 0) * {1 - damping!r}))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
