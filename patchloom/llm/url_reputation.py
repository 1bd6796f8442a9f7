"""URL filter: explicit rules first, then empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (``block`` = 1, ``allow`` = 0) are counted for every host, registered domain and
public suffix. Each level's counts are shrunk toward its parent's posterior mean by a beta prior whose
strength is estimated from the spread between the units of that level (beta-binomial method of moments),
so a host with two labelled pages leans on its domain and one with two thousand stands on its own. An
unlabelled page is blocked when the lower posterior bound ``mean - z * sd`` of its host exceeds
``threshold``.

Defined cases: a null url or one without ``://`` has an empty host and path; a url whose path is empty
fits no rule whose path is ``/``; a host without labelled pages gets its domain's prior; a table without
labelled pages allows everything; repeated rows are judged alike; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.storage import materialize

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (after the first ``://``, A-Z lower-cased) and ``path`` (then up to ``?`` or ``#``)."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def _fits(host: str, path: str) -> Column:
    on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return on_host & F.col("path").startswith(path)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest fitting rule (ties: the smaller text), else nulls.

    ``rules`` is a parameter list, not data: it becomes one CASE expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        rule = F.when(_fits(host, path), F.lit(host + path)).otherwise(rule)
        verdict = F.when(_fits(host, path), F.lit(kind)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


#: What a host may have besides its name: a user part before, a port behind. An address is its own domain and suffix.
AROUND, ADDRESS = r"^.*@|:[0-9]*$", r"^[0-9.]+$|^\["


def _domain_suffix(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the public suffix; ``suffixes`` lists the suffixes of two labels."""
    name = F.regexp_replace(host, AROUND, "")
    address = name.rlike(ADDRESS)
    wide = F.substring_index(name, ".", -2).isin(*suffixes)
    suffix = F.when(wide, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(wide, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def _strength(units: DataFrame, key: str) -> DataFrame:
    """One row: the prior strength of a level, from the spread of its labelled units around their parents' means.

    Kleinman's moments, summed over the parents; the correlation is held between 0.01 and 0.5, so a parent
    counts for 1 to 99 pages."""
    level = units.where("n > 0").groupBy(key).agg(
        F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.count("*").cast("double").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    )
    one = F.expr("(k / n) * (1 - k / n)")
    spread = F.expr("kk - k * k / n") - one * (F.col("g") - 1)
    room = one * (F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1))
    total = level.agg(F.sum(spread).alias("spread"), F.sum(room).alias("room"))
    rho = F.try_divide("spread", F.when(F.col("room") > 1e-9, F.col("room")))
    return total.select((1 / F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.01)), F.lit(0.5)) - 1).alias("s"))


def _shrink(units: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Posterior ``a``, ``b`` and ``mean`` of each unit under its parent's mean."""
    prior = parents.select(F.col(key).alias("_up"), F.col("mean").alias("_m"))
    joined = units.join(prior, F.col(key) == F.col("_up"), "left")
    m, w = F.coalesce("_m", F.lit(0.5)), F.coalesce(_strength(units, key).scalar(), F.lit(1.0))
    a, b = w * m + F.col("k"), w * (1 - m) + F.col("n") - F.col("k")
    return joined.withColumns({"a": a, "b": b}).withColumn("mean", F.expr("a / (a + b)")).drop("_up", "_m")


def host_reputation(pages: DataFrame, z: float = 1.0, threshold: float = 0.5, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per host: ``n`` labelled pages, ``k`` blocked ones, ``bound`` and ``verdict``.

    ``pages`` has ``host`` and ``outcome`` (1 block, 0 allow, null unlabelled). The first aggregation is
    partial on the map side, so a host with a third of the pages costs one row a task."""
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("k"))
    domain, suffix = _domain_suffix(F.col("host"), suffixes)
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    whole = suffixes.groupBy("all").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = whole.withColumn("mean", (F.col("k") + 0.5) / (F.col("n") + 1.0))
    suffixes = _shrink(suffixes, whole, "all")
    domains = _shrink(domains, suffixes, "suffix")
    hosts = _shrink(hosts, domains, "domain")
    sd = F.expr("sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))")
    bound = F.col("mean") - z * sd
    return hosts.select("host", "n", "k", bound.alias("bound"), F.when(bound > threshold, "block").otherwise("allow").alias("verdict"))


def url_filter(pages: DataFrame, rules=RULES, z: float = 1.0, threshold: float = 0.5, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; the rules' verdicts are the labels.

    ``suffixes`` are the suffixes of two labels under which names are registered; a full list of public suffixes goes here.

    Pages without a rule are joined with their host's verdict in a plain equi-join of two shuffled sides,
    which adaptive execution splits when one host is hot."""
    judged = with_rule(with_host_path(pages.select("page_id", "url")), rules)
    outcome = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    verdicts = materialize(host_reputation(judged.select("host", outcome.alias("outcome")), z, threshold, suffixes).select("host", "verdict"), "host-verdicts")
    ruled = judged.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))
    rest = judged.where("rule IS NULL").drop("rule_verdict", "url").join(verdicts, "host", "left")
    return ruled.unionByName(rest.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")))


def oracle(z: float = 1.0, threshold: float = 0.5) -> str:
    """The same computation as one DuckDB statement over ``pages``."""
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"

    def strength(level: str, key: str) -> str:
        return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN room > 1e-9 THEN spread / room END, 0.5), 0.01), 0.5) - 1
          FROM (SELECT sum(kk - k * k / n - (k / n) * (1 - k / n) * (g - 1)) AS spread, sum((k / n) * (1 - k / n) * (n - nn / n - (g - 1))) AS room
          FROM (SELECT {key}, sum(n)::DOUBLE n, sum(k)::DOUBLE k, count(*)::DOUBLE g, sum(n::DOUBLE * n) nn, sum(k::DOUBLE * k / n) kk FROM {level} WHERE n > 0 GROUP BY {key})))"""

    def shrink(level: str, parent: str, key: str) -> str:
        return f"""SELECT *, a / (a + b) AS mean FROM (SELECT u.*, coalesce({strength(level, key)}, 1.0) * coalesce(q.mean, 0.5) + u.k AS a,
          coalesce({strength(level, key)}, 1.0) * (1 - coalesce(q.mean, 0.5)) + u.n - u.k AS b FROM {level} u LEFT JOIN {parent} q ON u.{key} = q.{key})"""

    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict FROM split),
hosts0 AS (SELECT host, regexp_replace(host, '{AROUND}', '', 'g') AS name, count(rule_verdict) AS n, coalesce(sum(CASE rule_verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END), 0) AS k FROM judged GROUP BY host),
hosts AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM hosts0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS one, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
whole AS (SELECT 1 AS one, (sum(k) + 0.5) / (sum(n) + 1.0) AS mean FROM suffixes),
suffix_post AS ({shrink('suffixes', 'whole', 'one')}),
domain_post AS ({shrink('domains', 'suffix_post', 'suffix')}),
host_post AS ({shrink('hosts', 'domain_post', 'domain')})
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.rule_verdict, CASE WHEN h.mean - {z} * sqrt(h.a * h.b / ((h.a + h.b) * (h.a + h.b) * (h.a + h.b + 1))) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN host_post h ON j.host = h.host"""
