"""URL filter by rules and empirical-Bayes host reputation, in SQL only.

Pages that a rule judges are labelled outcomes (block: bad).  Outcomes are
counted by host, registered domain and public suffix (of the name without user and
port; numeric addresses are domains of one suffix).  Each level's bad rate is
shrunk to that of the level above through a beta prior whose strength comes from
the spread between siblings (method of moments for beta-binomial counts):
suffix to all pages, domain to suffix, host to domain; what a level does not
know widens the priors below it.  A page that no rule
judges is blocked if the lower bound of its host's posterior bad rate (mean
less ``z`` standard deviations) is over ``limit``.  Hosts without outcomes get
their domain's prior; being wide, it blocks only on strong evidence from above.

Null URLs and those without ``://`` have empty host and path and are judged like
a host without outcomes.  Page ids may repeat or be null: a result row for each
row.  Columns besides the id and the URL are ignored, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidegrove.llm.common import join_skewed, ready_checkpoints, table

#: Fixed values: (verdict, host, path) of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Suffixes of two labels under which domains are registered (extend by parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")


@dataclass(frozen=True)
class ReputationConfig:
    """z: standard deviations below the mean; limit: bound over which a host is blocked."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES
    z: float = 1.645
    limit: float = 0.5


def _quote(text: str) -> str:
    if "\\" in text:
        raise ValueError("a backslash in a rule or suffix")
    return "'" + text.replace("'", "''") + "'"


def judged_sql(cfg: ReputationConfig, pages: str = "pages") -> str:
    """The parts of each URL and the rule that fits it: the longest one, tried first."""
    rules = sorted(cfg.rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))

    def case(value, other: str) -> str:
        tests = (
            f"WHEN (host = {_quote(h)} OR right(host, {len(h) + 1}) = {_quote('.' + h)}) AND left(path, {len(p)}) = {_quote(p)} THEN {_quote(value(v, h, p))}" for v, h, p in rules
        )
        return f"CASE {' '.join(tests)} ELSE {other} END" if rules else other

    rest = "substring(url, instr(url, '://') + 3)"
    lower = f"translate({{}}, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    has = "CASE WHEN instr(url, '://') > 0 THEN {} ELSE '' END"
    return f"""
    SELECT *, {case(lambda v, h, p: h + p, "CAST(NULL AS {text})")} AS rule,
           {case(lambda v, h, p: v, "CAST(NULL AS {text})")} AS ruled
    FROM (SELECT page_id,
                 {has.format(lower.format(f"regexp_extract({rest}, '^[^/?#]*', 0)"))} AS host,
                 {has.format(f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)")} AS path
          FROM {pages}) AS parts"""


def _strength(children: str, parent_rate: str) -> str:
    """The prior's strength, one row: (1 - g) / g for the intraclass correlation g, held within 0.1 to 1000."""
    return f"""
    SELECT CASE WHEN spare > 0 AND pq > 0
                THEN greatest(0.1, least(1000.0, (1 - g) / greatest(g, 0.000001))) ELSE 1000.0 END AS k
    FROM (SELECT spare, pq, CASE WHEN spare > 0 AND pq > 0 THEN (ss / pq - units) / spare ELSE 0.0 END AS g
          FROM (SELECT sum(n * power(bad / n - {parent_rate}, 2)) AS ss,
                       count(*) - 1 AS units,
                       sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spare,
                       sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS pq
                FROM {children} WHERE n > 0) AS sums) AS gs"""


def _posterior(keys: str, children: str, k: str) -> str:
    """Rate and variance of each child, whose prior has the parent's rate ``up``.

    The prior's variance is the parent's own plus that between siblings, so little
    evidence above leaves a wide prior; a beta of that mean and variance stands for it."""
    return f"""
    SELECT {keys}, a / (a + b) AS rate, a * b / ((a + b) * (a + b) * (a + b + 1)) AS var
    FROM (SELECT *, bad + strength * up AS a, n - bad + strength * (1 - up) AS b
          FROM (SELECT *, greatest(0.01, up * (1 - up) / (var + up * (1 - up) / ((SELECT k FROM {k}) + 1)) - 1) AS strength
                FROM {children}) AS priors) AS counts"""


def counts_sql(judged: str) -> str:
    """Pages, labelled pages and bad ones among them, by host."""
    return f"SELECT host, count(*) AS pages, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(CASE WHEN ruled = 'block' THEN 1 END) AS DOUBLE) AS bad FROM {judged} GROUP BY host"


def hosts_sql(cfg: ReputationConfig, counted: str) -> str:
    """Hosts with the registered domain and the suffix of their name, without user and port; an address is a domain of its own."""
    two = ", ".join(map(_quote, cfg.suffixes)) or "''"
    tail2, tail3 = "regexp_extract(site, '[^.]+[.][^.]+$', 0)", "regexp_extract(site, '[^.]+[.][^.]+[.][^.]+$', 0)"
    last = "regexp_extract(site, '[^.]+$', 0)"
    address = "(site LIKE '[%' OR regexp_extract(site, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$', 0) <> '')"
    return f"""
    SELECT host, CASE WHEN {address} THEN '[]' WHEN {tail2} IN ({two}) THEN {tail2} ELSE {last} END AS suffix,
           CASE WHEN {address} THEN site WHEN {tail2} IN ({two}) AND {tail3} <> '' THEN {tail3} WHEN {tail2} <> '' THEN {tail2} ELSE site END AS domain, pages, n, bad
    FROM (SELECT *, CASE WHEN left(name, 1) = '[' THEN substring(name, 1, instr(name, ']')) ELSE regexp_extract(name, '^[^:]*', 0) END AS site
          FROM (SELECT *, regexp_extract(host, '[^@]*$', 0) AS name FROM ({counted}) AS counted) AS named) AS sites"""


def levels_sql(cfg: ReputationConfig, hosts: str) -> dict[str, str]:
    """By name, in order, the tables of rates from the suffixes down to the hosts."""
    return {
        "hosts": hosts,
        "domains": "SELECT domain, suffix, count(*) AS hosts_, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix",
        "suffixes": "SELECT suffix, count(*) AS domains_, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix",
        "everything": "SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate FROM suffixes",
        "suffix_k": _strength("suffixes", "(SELECT rate FROM everything)"),
        "suffix_up": "SELECT suffix, domains_, n, bad, (SELECT rate FROM everything) AS up, 0.0 AS var FROM suffixes",
        "suffix_rates": _posterior("suffix, domains_", "suffix_up", "suffix_k"),
        "domains_up": "SELECT d.domain, d.suffix, d.hosts_, d.n, d.bad, s.rate AS up, s.var FROM domains d JOIN suffix_rates s ON d.suffix = s.suffix",
        "domain_k": _strength("domains_up", "up"),
        "domain_rates": _posterior("domain, suffix, hosts_", "domains_up", "domain_k"),
        "hosts_up": "SELECT h.host, h.pages, h.n, h.bad, d.rate AS up, d.var FROM hosts h JOIN domain_rates d ON h.domain = d.domain AND h.suffix = d.suffix",
        "host_k": _strength("hosts_up", "up"),
        "bounds": f"""
    SELECT host, pages, CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad, round(greatest(0.0, rate - {cfg.z} * sqrt(var)), 6) AS host_bound
    FROM ({_posterior("host, pages, n, bad", "hosts_up", "host_k")}) AS posteriors""",
    }


def _verdicts(cfg: ReputationConfig, joined: str) -> str:
    return f"""
SELECT page_id, host, path, rule,
       CASE WHEN ruled IS NOT NULL THEN ruled WHEN host_bound > {cfg.limit} THEN 'block' ELSE 'allow' END AS verdict,
       host_labelled, host_bad, host_bound
FROM {joined}"""


def reputation_sql(cfg: ReputationConfig, judged: str) -> str:
    """One row per page, as one query; ``judged`` is that of ``judged_sql``."""
    levels = ",\n".join(f"{name} AS ({sql})" for name, sql in levels_sql(cfg, hosts_sql(cfg, counts_sql("judged"))).items())
    return f"WITH judged AS ({judged}),\n{levels}" + _verdicts(cfg, "(SELECT j.*, b.host_labelled, b.host_bad, b.host_bound FROM judged j JOIN bounds b ON j.host = b.host) AS joined")


def url_verdicts(pages: DataFrame, cfg: ReputationConfig = ReputationConfig(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: its host, path, rule, verdict and the evidence on its host.

    Pages are counted by host before anything is shuffled.  Each level's table is checkpointed, so it is made once;
    domains, hosts and pages are joined with their level above with hot keys (a suffix, domain or host with many
    rows) broadcast, so that no key is one task."""
    spark = pages.sparkSession
    pair = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    judged = spark.sql(judged_sql(cfg, "{pages}").replace("{text}", "STRING"), pages=pair)
    ready_checkpoints(spark)
    made: dict[str, DataFrame] = {}
    above = {"domains_up": ("domains", "suffix_rates", ["suffix"], "domains_"), "hosts_up": ("hosts", "domain_rates", ["domain", "suffix"], "hosts_")}
    for name, sql in levels_sql(cfg, hosts_sql(cfg, counts_sql("{judged}"))).items():
        if name in above:
            rows, names, keys, copies = above[name]
            found = join_skewed(made[rows], made[names].withColumnRenamed("rate", "up"), keys, copies)
        else:
            known = [x for x in made if re.search(rf"\b(FROM|JOIN) {x}\b", sql)]
            for x in known:
                sql = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", sql)
            found = spark.sql(sql, **{x: made[x] for x in known}, **({"judged": judged} if name == "hosts" else {}))
        made[name] = found.checkpoint()
    joined = join_skewed(judged, made["bounds"], ["host"], "pages")
    return spark.sql(_verdicts(cfg, "{joined}"), joined=joined).withColumnRenamed("page_id", id_col)


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


_CFG = ReputationConfig()
OP3_SQL = reputation_sql(_CFG, judged_sql(_CFG).replace("{text}", "VARCHAR"))
