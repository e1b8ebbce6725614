"""URL filter by empirical-Bayes host reputation.

Labelled pages give good and bad outcomes per host. Each level of host ->
registered domain -> public suffix -> everything is a beta-binomial: a node's
rate is shrunk towards its parent's by a prior strength (pseudo-counts) that
the method of moments estimates from how much the nodes of the level differ.
A host is blocked when even the upper bound of its posterior rate of good
pages is below ``least_good``; hosts that nobody has labelled take their
parent's rate. Explicit rules come first, the longest fitting one wins.

All DataFrame operations. Outcomes are counted per host before anything is
joined, so a host with a third of all pages is one row from then on; the join
back has one row per host on the right.

Defined results: a null url, or one without ``://``, has an empty host and path
and counts under the host ''. Repeated page rows stay; each counts as an
outcome. Null labels are no outcomes. Without any outcome every rate is 1/2,
which blocks nothing. Columns of the input beyond
``id_column`` and ``url_column`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host + path); a rule list is a parameter of at most this many rules.
Rule = tuple[str, str]
MOST_RULES = 1000

#: Public suffixes of several labels; a parameter of at most MOST_SUFFIXES. Any other host's suffix is its last label.
SUFFIXES = tuple((
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr go.kr ac.kr co.in net.in org.in gov.in ac.in com.br net.br org.br gov.br com.cn net.cn org.cn "
    "gov.cn edu.cn com.tw org.tw com.hk org.hk com.sg com.my com.ph com.vn co.id co.th in.th com.tr com.mx com.ar com.co com.pe com.ve com.ec "
    "co.za org.za com.ng co.ke com.eg com.sa co.il org.il com.ua com.pl com.pt com.es com.gr com.ru "
    "github.io gitlab.io blogspot.com wordpress.com netlify.app vercel.app pages.dev web.app firebaseapp.com herokuapp.com appspot.com").split())
MOST_SUFFIXES = 20_000


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))


def raw_host(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)


def url_host(url: Column) -> Column:
    return F.translate(raw_host(url), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.substr(after_scheme(url), F.length(raw_host(url)) + F.lit(1))
    return F.regexp_extract(rest, "^[^?#]*", 0)


def site_name(host: Column) -> Column:
    """The host without a port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _last_labels(host: Column, suffixes: Sequence[str], more: int) -> Column:
    """The longest fitting suffix, else the last label, with ``more`` labels before it."""
    if len(suffixes) > MOST_SUFFIXES:
        raise ValueError(f"at most {MOST_SUFFIXES} suffixes")
    name = site_name(host)
    out = F.substring_index(name, ".", -1 - more)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        fits = F.substring_index(name, ".", -k).isin([s for s in suffixes if s.count(".") + 1 == k])
        out = F.when(fits, F.substring_index(name, ".", -k - more)).otherwise(out)
    return F.when(name.rlike(r"^([0-9]+\.){3}[0-9]+$|^\["), name).otherwise(out)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: the longest of ``suffixes`` that fits, else the last label; an IP address is its own."""
    return _last_labels(host, suffixes, 0)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the public suffix."""
    return _last_labels(host, suffixes, 1)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))


def matched_rule(rules: Sequence[Rule], host: Column, path: Column, field: int) -> Column:
    """Field 0 (action) or 1 (text) of the longest fitting rule, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        out = F.when(rule_fits(rule[1], host, path), F.lit(rule[field])).otherwise(out)
    return out


def level_prior(level: DataFrame, least: float, most: float) -> DataFrame:
    """One row: ``mean`` and ``strength`` of the prior of a level's nodes
    (columns good, n), by the method of moments; strength is in pseudo-counts."""
    total = level.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("k"),
                      F.sum(F.col("n") * F.col("n")).alias("nn"),
                      F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"))
    n, p = F.col("n"), F.try_divide("good", "n")
    # sum of n_i (p_i - p)^2 = sum good_i^2 / n_i - p^2 sum n_i
    spread = F.col("gg") - p * p * n - (F.col("k") - 1) * p * (1 - p)
    between = F.try_divide(spread, n - F.try_divide("nn", "n"))
    strength = F.when(between > 0, p * (1 - p) / between - 1).otherwise(F.lit(most))
    return total.select(F.coalesce(p, F.lit(0.5)).alias("mean"),
                        F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(strength, F.lit(least)))).alias("strength"))


def reputation(outcomes: DataFrame, least: float = 1.0, most: float = 1000.0, z: float = 1.645,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host``, ``n``, ``good``, ``rate`` and the bounds ``low`` and ``high`` of the
    posterior, for every host of ``outcomes`` (host, good: 1, 0 or null)."""
    hosts = (outcomes.groupBy("host").agg(F.count("good").alias("n"),
                                          F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
             .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def shrunk(level: DataFrame, parent: Column, rate: str) -> DataFrame:
        strength = level_prior(level.where("n > 0"), least, most).select("strength").scalar()
        return level.withColumn("_k", strength).withColumn(
            rate, (F.col("good") + F.col("_k") * parent) / (F.col("n") + F.col("_k")))

    overall = level_prior(suffixes.where("n > 0"), least, most).select("mean").scalar()
    suffixes = shrunk(suffixes, overall, "suffix_rate").select("suffix", "suffix_rate")
    domains = shrunk(domains.join(suffixes, "suffix"), F.col("suffix_rate"), "domain_rate").select("domain", "domain_rate")
    hosts = shrunk(hosts.join(domains, "domain"), F.col("domain_rate"), "rate")
    half = F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("_k") + 1))
    return hosts.select("host", "n", "good", "rate", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], id_column: str = "page_id",
          url_column: str = "url", label_id: str = "doc_id", least_good: float = 0.5, least: float = 1.0,
          most: float = 1000.0, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``id_column``, ``host``, ``path``, ``rule``, ``verdict`` and ``n_labelled`` (outcomes
    of the host) for every page. A page's outcome is good when its label says
    quality 1 and not toxic."""
    url = F.col(url_column)
    seen = pages.select(F.col(id_column).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("long"))
    outcome = labels.select(F.col(label_id).alias("_id"), good.alias("good"))
    outcome = outcome.groupBy("_id").agg(F.min("good").alias("good"))  # one outcome a page; a bad label wins
    outcomes = seen.select("_id", "host").join(outcome, "_id", "left").select("host", "good")
    hosts = reputation(outcomes, least, most, z, suffixes).select("host", F.col("n").alias("n_labelled"),
                                                        (F.col("high") < least_good).alias("_bad"))
    judged = seen.join(hosts, "host")
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_id").alias(id_column), "host", "path", matched_rule(rules, host, path, 1).alias("rule"),
                         F.coalesce(matched_rule(rules, host, path, 0), by_method).alias("verdict"), "n_labelled")
