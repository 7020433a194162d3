"""URL filters: rules on hosts and paths, and an empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .laws import beta_at_most
from .shared import WORD, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: ('net/', 'block'): host, then path from the first /."""
    name = verdict = F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, outcome).otherwise(verdict)
    return name, verdict


#: Names under which registries of countries give out domains, so that a registered domain has three labels there.
#: A deployment gives the public suffix list that it trusts.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br",
    "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za",
)
#: User names before a host and ports behind it are not part of its name.
_EXTRA, _ADDRESS = r"^.*@|:[0-9]*$", r"^[0-9.]+$|^\["


def levels_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host: the suffix is its last label, or its last two where they are in suffixes; the domain
    has one label more. An address is its own domain and suffix."""
    name = F.regexp_replace(host, _EXTRA, "")
    two = F.substring_index(name, ".", -2)
    double, address = two.isin(*suffixes), name.rlike(_ADDRESS)
    domain = F.when(address, name).when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, name).when(double, two).otherwise(F.substring_index(name, ".", -1))


def _kappa(groups: DataFrame) -> DataFrame:
    """One row: kappa, the prior's weight in pages by the method of moments, in [1, 1000]; 1000 where rates don't differ."""
    seen = groups.where("n > 0").withColumns({"n": F.col("n").cast("double"), "bad": F.col("bad").cast("double")})
    base = seen.agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"))
    rate = F.col("b") / F.col("t")
    room = F.col("t") - F.col("n2") / F.col("t")
    between = F.when(room > 0, (F.col("b2") - F.col("b") * rate - (F.col("k") - 1) * rate * (1 - rate)) / room)
    kappa = F.when((F.col("k") > 1) & (between > 0), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), rate * (1 - rate) / between - 1))).otherwise(F.lit(1000.0))
    return base.select(kappa.alias("kappa"))


def reputations(pages: DataFrame, limit: float = 0.5, host_col: str = "host", bad_col: str = "bad", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, bad_rate, doubt for every host of pages: its pages with an outcome and the bad ones among them, the posterior
    mean rate of bad pages, and the posterior probability that the rate is at most limit, exactly by the beta distribution.

    Rates shrink from host to registered domain to suffix to all, each level under a beta prior with its parent's posterior
    mean; the weight of each level's priors is estimated from all groups of that level. So a host without outcomes has the
    posterior of its domain or suffix as its prior and is judged by that. bad_col: true, false, or null for no outcome. The rate
    of all is (bad + 1) / (pages + 2). Pages of a host are summed before any shuffle.
    """
    host = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(bad_col).alias("n"), F.coalesce(F.sum(F.col(bad_col).cast("long")), F.lit(0)).alias("bad"))
    domain, suffix = levels_of(F.col("host"), suffixes)
    host = materialize(host.withColumn("domain", domain).withColumn("suffix", suffix), "hosts", few_files=True)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domain = host.groupBy("domain", "suffix").agg(*sums)
    suffix = domain.groupBy("suffix").agg(*sums)
    top = suffix.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))
    shrunk = (F.col("bad") + F.col("kappa") * F.col("prior")) / (F.col("n") + F.col("kappa"))
    # One row each: the rate of all, and the weights of the levels' priors.
    s = suffix.join(F.broadcast(top)).join(F.broadcast(_kappa(suffix))).select("suffix", shrunk.alias("prior"))
    d = domain.join(F.broadcast(_kappa(domain))).join(s, "suffix").select("domain", "suffix", shrunk.alias("prior"))
    h = host.join(F.broadcast(_kappa(host))).join(d, ["domain", "suffix"])
    doubt = beta_at_most(limit, F.col("bad") + F.col("kappa") * F.col("prior"), F.col("n") - F.col("bad") + F.col("kappa") * (1 - F.col("prior")))
    return h.select("host", "n", "bad", F.round(shrunk, 6).alias("bad_rate"), F.round(doubt, 6).alias("doubt"))


#: What isn't text of a page.
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


def thin(html: Column, least_words: int = 50) -> Column:
    """Whether a page's text has fewer than least_words words, as the base rule of quality has it; null for a null page."""
    return F.regexp_count(F.regexp_replace(html, _MARKUP, " "), F.lit(WORD)) < least_words


def filtered(pages: DataFrame, bad: Column, rules: Sequence[tuple[str, str]], limit: float = 0.5, most_doubt: float = 0.05, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, bad_rate, doubt for every row of pages.

    The longest rule that fits decides; else a page is blocked if its host's rate of bad pages is over limit but for a posterior
    probability of at most most_doubt, which is to say that the posterior's bound at most_doubt is over limit. bad: the outcome
    of a page, a column over pages (true, false, or null for none). Urls that are null or without :// are of the empty host,
    which has a reputation like others. Null and repeated ids are pages like others; an empty table gives an empty result;
    columns that bad doesn't read are not read. A hot host is one row of each task before it is shuffled, and pages meet hosts
    by a join whose large partitions can be split.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), bad.alias("bad"))
    known = reputations(rows, limit)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.drop("bad").join(known.select("host", "bad_rate", "doubt"), "host")
    own = F.when(F.col("doubt") <= most_doubt, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "doubt")


#: The rules that the query is told.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _sql_rule(rules: Sequence[tuple[str, str]]) -> tuple[str, str]:
    def case(i: int) -> str:
        whens = " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{(t, o)[i]}'" for t, o in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True))
        return f"CASE {whens} END"

    return case(0), case(1)


def _sql_kappa(table: str) -> str:
    return f"""(SELECT CASE WHEN k > 1 AND btw > 0 THEN greatest(1.0, least(1000.0, rate * (1 - rate) / btw - 1)) ELSE 1000.0 END::DOUBLE FROM
      (SELECT k, rate, CASE WHEN t - n2 / t > 0 THEN (b2 - b * rate - (k - 1) * rate * (1 - rate)) / (t - n2 / t) END AS btw FROM
        (SELECT count(*) AS k, sum(n)::DOUBLE AS t, sum(bad)::DOUBLE AS b, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS b2, sum(bad)::DOUBLE / sum(n) AS rate FROM {table} WHERE n > 0) x) y)"""


#: The probability that a beta variable of a, b is at most 0.5, by another way than the query's: its density over the logit z is
#: exp(a ln t + b ln(1 - t)); the trapezoid rule on both sides of z = 0, with z = +-exp(w).
_SQL_HALF = "list_sum(list_transform(range(-2400, 1000), lambda i: exp(a * ln(1 / (1 + exp({sign}exp(i / 60.0::DOUBLE)))) + b * ln(1 / (1 + exp(-({sign}exp(i / 60.0::DOUBLE))))) - peak + i / 60.0::DOUBLE)))"
_SUFFIX_LIST = ", ".join(f"'{x}'" for x in SUFFIXES)

#: DuckDB's SQL of the query.
SQL = f"""
WITH r AS MATERIALIZED (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                  len(regexp_extract_all(regexp_replace(html, '{_MARKUP}', ' ', 'g'), '{WORD}')) < 50 AS bad FROM pages),
o AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad FROM r GROUP BY ALL),
q AS (SELECT *, string_split(name, '.') AS p, regexp_matches(name, '{_ADDRESS}') AS address, array_to_string(string_split(name, '.')[-2:], '.') IN ({_SUFFIX_LIST}) AS dbl FROM o),
h AS MATERIALIZED (SELECT host, n, bad, CASE WHEN address THEN name WHEN dbl THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
             CASE WHEN address THEN name WHEN dbl THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM q),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY ALL),
ps AS (SELECT suffix, (bad + kappa * prior) / (n + kappa) AS prior FROM s, (SELECT (sum(bad)::DOUBLE + 1) / (sum(n) + 2) AS prior, {_sql_kappa('s')} AS kappa FROM s) g),
pd AS (SELECT domain, suffix, (bad + kappa * prior) / (n + kappa) AS prior FROM d JOIN ps USING (suffix), (SELECT {_sql_kappa('d')} AS kappa) g),
ph AS (SELECT host, (bad + kappa * prior) / (n + kappa) AS m, bad + kappa * prior AS a, n - bad + kappa * (1 - prior) AS b FROM h JOIN pd USING (domain, suffix), (SELECT {_sql_kappa('h')} AS kappa) g),
pp AS (SELECT *, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS peak FROM ph),
k AS (SELECT host, round(m, 6) AS bad_rate, round(below / (below + above), 6) AS doubt FROM (SELECT host, m, {_SQL_HALF.format(sign='')} AS below, {_SQL_HALF.format(sign='-')} AS above FROM pp) x)
SELECT page_id, host, path, {_sql_rule(RULES)[0]} AS rule, coalesce({_sql_rule(RULES)[1]}, CASE WHEN doubt <= 0.05 THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, doubt
FROM r JOIN k USING (host)
"""
