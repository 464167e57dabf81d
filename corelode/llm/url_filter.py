"""URL rules, and verdicts from the link graph for hosts that no rule covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import ascii_lower
from corelode.session import keep

# Scores are whole numbers: sums do not depend on the order of their terms.
MASS = 1_000_000_000_000
# Percent of a host's score that follows its links.
FOLLOW = 85
# Rounds: 0.85^30 = 0.8 % of the scores have not arrived then, and a host over 30 links from every seed has none.
ITERATIONS = 30
# Iterations planned as one job before their result is written to the shared folder.
STEPS_PER_JOB = 5
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""

Rule = tuple[str, str]


def after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))


def host_and_path(pages: DataFrame) -> DataFrame:
    """``pages`` (with ``url``) plus ``host`` (lower case) and ``path``."""
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    return pages.select("*", ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def best_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    def fits(rule: str) -> Column:
        host, _, rest = rule.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{rest}")

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    rule = reduce(lambda chain, r: F.when(fits(r[1]), F.lit(r[1])).otherwise(chain), reversed(ordered), F.lit(None).cast("string"))
    verdict = reduce(lambda chain, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(chain), ordered, F.lit(None).cast("string"))
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: (src, dst).

    Hyperlinks with a host of their own, and the tie of a host to its parent
    domain (down to two labels), in both directions. Relative links stay inside
    their host and move no score.
    """
    target = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link")
    hyper = pages.select(F.col("host").alias("src"), target).select("src", ascii_lower(F.regexp_extract("link", "//([^/?#]*)", 1)).alias("dst"))
    child = pages.select("host").distinct().filter(F.size(F.split("host", r"\.")) > 2)
    parent = child.select(F.col("host").alias("src"), F.expr("substring(host, locate('.', host) + 1)").alias("dst"))
    both = parent.unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return hyper.unionByName(both).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Personalised PageRank of each kind: (kind, host, score).

    ``edges`` (kind, src, dst), ``seeds`` (kind, host, seed). A host passes
    FOLLOW percent of its score on, in equal parts; the seeds are refilled with
    the rest. Whole-number division rounds down.
    """
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    links = keep(edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", "degree"))
    refill = keep(seeds).select("kind", "host", F.expr(f"seed * {100 - FOLLOW} div 100").alias("score"))
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    for step in range(1, iterations + 1):
        moved = scores.join(links, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr(f"score * {FOLLOW} div (100 * degree)").alias("score"))
        scores = moved.unionByName(refill).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % STEPS_PER_JOB == 0 and step < iterations:
            scores = keep(scores)
    return scores


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", iterations: int = ITERATIONS, margin: float = 1.0,
) -> DataFrame:
    """A verdict for each row of ``pages``: by the longest fitting rule, else by its host's scores.

    Hosts with pages that a rule allows are trusted seeds, in proportion to
    those pages; trust follows the links. Hosts with blocked pages are blocked
    seeds; distrust follows the links backwards, to those who link to them. A
    page without a rule is blocked if its host's distrust exceeds ``margin``
    times its trust, so a host that neither reaches within ``iterations`` links is allowed.

    The host is what stands between the first ``://`` and ``/``, ``?``, ``#`` or
    the end, A-Z in lower case; the path runs on to ``?``, ``#`` or the end.
    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and are allowed. Null html has no links. Each row gets its own verdict,
    repeated or null ids too; an empty table gives no rows; other columns go.

    Returns page_id, host, path, rule, verdict, trust, distrust.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rule, verdict = best_rule(rules)
    ruled = host_and_path(named).withColumn("rule", rule).withColumn("verdict", verdict)
    counts = ruled.filter("rule IS NOT NULL").groupBy(
        F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(totals), "kind").select(  # two rows
        "kind", "host", F.expr(f"CAST(floor(CAST(n AS DOUBLE) / total * {MASS}) AS BIGINT)").alias("seed"))
    links = keep(host_links(ruled))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    scores = propagate(edges, seeds, iterations)
    hosts = scores.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(k) for k in ("trust", "distrust")))
    score = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("trust", "distrust")}
    judged = ruled.select("page_id", "host", "path", "rule", "verdict").join(hosts, "host", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(score["distrust"] > score["trust"] * margin, "block").otherwise("allow")).alias("verdict"),
        score["trust"].alias("trust"), score["distrust"].alias("distrust"))


def judge_sql(rules: list[Rule], iterations: int = ITERATIONS) -> str:
    """The same in DuckDB's SQL."""
    def fits(rule: str) -> str:
        host, _, rest = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    which = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules) + " END"
    lower = f"translate({{}}, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    steps = "\n".join(f"""s{i} AS MATERIALIZED (SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM (
 SELECT kind, dst AS host, score * {FOLLOW} // (100 * degree) AS score FROM s{i - 1} JOIN links USING (kind, host)
 UNION ALL SELECT kind, host, seed * {100 - FOLLOW} // 100 FROM seeds) GROUP BY kind, host),""" for i in range(1, iterations + 1))
    return f"""WITH parts AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
matched AS (SELECT *, {which} AS rule FROM split),
ruled AS MATERIALIZED (SELECT *, {verdict} AS verdict FROM matched),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS link FROM ruled),
parents AS (SELECT DISTINCT host AS src, substr(host, strpos(host, '.') + 1) AS dst FROM ruled WHERE len(string_split(host, '.')) > 2),
pairs AS (SELECT src, {lower.format("regexp_extract(link, '//([^/?#]*)', 1)")} AS dst FROM found UNION ALL SELECT src, dst FROM parents UNION ALL SELECT dst, src FROM parents),
one AS (SELECT DISTINCT src, dst FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst),
two AS (SELECT 'trust' AS kind, src AS host, dst FROM one UNION ALL SELECT 'distrust', dst, src FROM one),
links AS MATERIALIZED (SELECT kind, host, dst, count(*) OVER (PARTITION BY kind, host) AS degree FROM two),
counts AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE rule IS NOT NULL GROUP BY 1, 2),
seeds AS MATERIALIZED (SELECT kind, host, CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind) * {MASS}) AS BIGINT) AS seed FROM counts),
s0 AS (SELECT kind, host, seed AS score FROM seeds),
{steps}
hosts AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM s{iterations} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
 CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust FROM ruled LEFT JOIN hosts USING (host)"""
