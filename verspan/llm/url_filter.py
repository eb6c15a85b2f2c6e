"""URL filters: rules for hosts and paths, and trust and distrust spread over host links.

A rule is for a host with all its subdomains and for paths that begin with its path; of
those that fit a URL the longest decides (host and path together; of equally long ones
that with the longer host, then the smaller text). What no rule decides is judged by the
host's links:

- Seeds: the share of a host's pages that rules allow is its trust, the share that they
  block its distrust; a host that is only linked to is judged by its path ``/``.
- Both are personalised PageRanks of walks that take one link at least, then end with
  chance 1 - ``DAMPING`` after each link, and where there is no other. Trust is how many
  walks from trusted seeds end at a host, in hosts. Distrust goes the other way along the
  links: the share of the walks from a host that end on blocked pages. Neither depends on
  how many hosts there are.
- Both are sums of a power series: each round sends on only what the last one brought, so
  hosts that nothing reaches cost nothing. After ``ROUNDS`` rounds DAMPING ** ROUNDS of a
  walk's chance is left out, some 0.00004.
- A host is blocked whose distrust, seeds of its own not counted (a rule for a section
  says nothing of the rest), is at least ``THRESHOLD`` and above its trust.

All of it is DataFrame functions. Pages and links are aggregated to hosts and pairs of
hosts in the tasks that read them; joins by host have one row for each host on one side,
so that AQE can split a host with very many rows on the other.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule
that names a host and is allowed; a null html has no links; links within a host, without
a host, in comments, scripts and styles don't count; rows that share an id are judged
each; a null id stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import lower_ascii, scratch, stored, table

#: (verdict, host and path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DAMPING, ROUNDS, THRESHOLD = 0.6, 20, 0.3
#: Rules up to this number are an expression over each URL, beyond it a table that is joined by the URL hosts' suffixes.
MAX_INLINE = 64
#: What ends unclosed runs to the end of the page, so that no text is searched twice.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
LINK = r"""(?i)<a(?:rea)?[ \t\n\f\r](?:[^<>]*[ \t\n\f\r"'])?href[ \t\n\f\r]*=[ \t\n\f\r]*(?:["'][ \t\n\f\r]*)?((?:https?:)?//[^"'<> \t\n\f\r]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def link_hosts(html: Column) -> Column:
    """Distinct hosts that a page's absolute links lead to; the page is cleaned only if it has any."""
    found = lambda c: F.regexp_extract_all(c, F.lit(LINK), 1)
    urls = F.when(F.size(found(html)) > 0, found(F.regexp_replace(html, HIDDEN, " ")))
    return F.array_distinct(F.transform(urls, lambda u: lower_ascii(F.regexp_extract(u, r"//([^/?#]*)", 1))))


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _fits(host: Column, path: Column, rule: str) -> Column:
    h, p = _parts(rule)
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def _ruled_inline(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(_parts(r[1])[0]), r[1]))
    first = lambda value: F.coalesce(*[F.when(_fits(F.col("host"), F.col("path"), r[1]), value(r)) for r in order], F.lit(None).cast("string"))
    return urls.select("*", first(lambda r: F.lit(r[1])).alias("rule"), first(lambda r: F.lit(r[0])).alias("ruled"))


def _ruled_by_table(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each host's suffixes meet the rules once; a host's fitting rules, longest first, come back to its URLs."""
    spark = urls.sparkSession
    listed = spark.createDataFrame([(*_parts(r), r, v) for v, r in rules], "suffix string, prefix string, rule string, ruled string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1 << 20), "."))
    order = F.struct((-F.length("rule")).alias("n"), (-F.length("suffix")).alias("m"), "rule", "prefix", "ruled")
    hosts = urls.select("host").distinct().withColumn("suffix", F.explode(suffixes)).join(listed, "suffix").groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("fits"))
    best = F.get(F.filter("fits", lambda f: F.col("path").startswith(f["prefix"])), F.lit(0))
    return urls.join(hosts, "host", "left").withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, its verdict, to rows with ``host`` and ``path``; null where no rule fits."""
    rules = list(dict.fromkeys(rules))
    return _ruled_inline(urls, rules) if len(rules) <= MAX_INLINE else _ruled_by_table(urls, rules)


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, share): of the links that lead from a host to others, the share to one of them."""
    each = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(link_hosts(F.col(html_col))).alias("dst"))
    pairs = each.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("of"))
    return pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("of")).alias("share"))


def host_seeds(urls: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, trust, distrust) of the hosts of pages and of links, before anything is spread."""
    share = lambda verdict, name: (F.count_if(F.col("ruled") == verdict) / F.count("*")).alias(name)
    of_pages = urls.groupBy("host").agg(share("allow", "trust"), share("block", "distrust"))
    others = links.select(F.col("dst").alias("host")).distinct().join(of_pages, "host", "left_anti")
    root = ruled(others.withColumn("path", F.lit("/")), rules)
    one = lambda verdict: F.coalesce((F.col("ruled") == verdict).cast("double"), F.lit(0.0))
    return of_pages.union(root.select("host", one("allow"), one("block"))).where("trust > 0 or distrust > 0")


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of the hosts that something reaches, their own seeds not counted.

    links: (src, dst, share), distinct pairs; seeds: (host, trust, distrust), a row for each host.
    """
    sums = lambda df: df.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    going = links.select(F.col("src").alias("host")).distinct().withColumn("ends", F.lit(1 - damping))
    ends = F.coalesce("ends", F.lit(1.0))  # of the walks that come to a host, the share that ends there
    with scratch(links.sparkSession) as keep:
        now = seeds.join(going, "host", "left").select("host", "trust", (F.col("distrust") * ends).alias("distrust"))
        came = seeds.limit(0)
        for r in range(rounds):
            gain = F.col("share") * (damping if r else 1.0)
            to = links.join(now.where("trust > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (gain * F.col("trust")).alias("trust"), F.lit(0.0).alias("distrust"))
            back = links.join(now.where("distrust > 0"), F.col("dst") == F.col("host")).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (gain * F.col("distrust")).alias("distrust"))
            now = keep(sums(to.union(back)), "round")
            if now.isEmpty():
                break
            came = came.union(now)
        return stored(sums(came).join(going, "host", "left").select("host", (F.col("trust") * ends).alias("trust"), "distrust"), "trust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) of each page."""
    url = F.col(url_col)
    urls = ruled(pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    out = urls.withColumn("spread", F.lit(None).cast("string"))
    with scratch(pages.sparkSession) as keep:
        links = keep(host_links(pages, url_col, html_col), "links")
        if not links.isEmpty():
            seeds = keep(host_seeds(urls, links, rules), "seeds")
            bad = spread(links, seeds).where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("spread"))
            out = urls.join(bad, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql_ruled() -> str:
    """The rules as DuckDB's CASE, longest first."""
    order = sorted(RULES, key=lambda r: (-len(r[1]), -len(_parts(r[1])[0]), r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p in (_parts(r) for _, r in order)]
    return f"CASE {' '.join(f + repr(r) for f, (_, r) in zip(fits, order))} END AS rule, CASE {' '.join(f + repr(v) for f, (v, _) in zip(fits, order))} END AS ruled"


ORACLE = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, {_sql_ruled()} FROM u),
a AS (SELECT page_id, host AS src, unnest(list_distinct([translate(regexp_extract(x, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    FOR x IN regexp_extract_all(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{LINK.replace("'", "''")}', 1)])) AS dst FROM u),
w AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM a WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
l AS (SELECT 'trust' AS kind, src AS host, dst AS target, share FROM w UNION ALL SELECT 'distrust', dst, src, share FROM w),
o AS (SELECT *, {_sql_ruled()} FROM (SELECT DISTINCT dst AS host, '/' AS path FROM w WHERE dst NOT IN (SELECT host FROM r))),
h AS (SELECT host, ruled FROM r UNION ALL SELECT host, ruled FROM o),
g AS (SELECT host, CASE WHEN host IN (SELECT src FROM w) THEN 1 - {DAMPING} ELSE 1 END::DOUBLE AS ends FROM (SELECT src AS host FROM w UNION SELECT dst FROM w)),
t(kind, host, term, round) AS (
  SELECT kind, h.host, (count(*) FILTER (ruled = verdict) / count(*))::DOUBLE * any_value(CASE kind WHEN 'distrust' THEN ends ELSE 1 END), 0
    FROM h JOIN g USING (host), (VALUES ('trust', 'allow'), ('distrust', 'block')) k(kind, verdict) GROUP BY kind, h.host
  UNION ALL SELECT kind, target, sum(CASE round WHEN 0 THEN 1 ELSE {DAMPING} END * share * term)::DOUBLE, any_value(round) + 1 FROM t JOIN l USING (kind, host) WHERE term > 0 AND round < {ROUNDS} GROUP BY kind, target),
b AS (SELECT host, coalesce(sum(term) FILTER (kind = 'trust'), 0) * any_value(ends) AS trust, coalesce(sum(term) FILTER (kind = 'distrust'), 0) AS distrust FROM t JOIN g USING (host) WHERE round > 0 GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN b ON r.host = b.host
"""
