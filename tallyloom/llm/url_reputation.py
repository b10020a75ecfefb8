"""Host reputation by empirical Bayes, and URL rules that overrule it."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path); a rule is named host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty for null or without `://`."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, split, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, split, 2)


def _levels(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; addresses and single names stand for themselves.
    A host that is a listed suffix is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(*suffixes)
    plain = name.rlike(r"^[\d.]+$|^\[") | ~name.contains(".")
    suffix = F.when(listed, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(listed, F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(plain, name).otherwise(domain), F.when(plain, F.lit("")).otherwise(suffix)


def _strength(groups: DataFrame, rate: float) -> float:
    """How many outcomes the prior above a level weighs: by moments, from how far the groups' rates spread beyond what
    their sizes explain. Bounded to 1 .. 1000."""
    p = F.col("bad") / F.col("seen")
    row = groups.filter("seen > 0").agg(F.sum(F.col("seen") * (p - rate) * (p - rate)).alias("spread"), F.count("*").alias("n"), F.sum("seen").alias("all"), F.sum(F.col("seen") * F.col("seen")).alias("squares")).first()
    noise = rate * (1 - rate)
    if not row["n"] or row["n"] < 2 or row["all"] <= row["squares"] / row["all"]:
        return 1000.0
    between = (row["spread"] - (row["n"] - 1) * noise) / (row["all"] - row["squares"] / row["all"])
    return float(min(1000.0, max(1.0, noise / between - 1))) if between > 0 else 1000.0


def host_posteriors(pages: DataFrame, labels: DataFrame, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, seen, bad, alpha, beta: the beta posterior of each host's rate of bad pages.

    A page is bad if its label has quality 0 or toxic 1; a page with several labels is bad if one says so; pages without
    labels, or with null ones, count for no rate. The rate over all pages is the prior of the suffixes, a suffix's
    posterior mean that of its registered domains, a domain's that of its hosts. `two_labels`: suffixes of two labels; a
    domain belongs to its suffix, so equal names under two suffixes are two domains. Only three numbers reach the driver.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("is_bad"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), parts(F.col("url"))[0].alias("host"))
    hosts = own.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("is_bad").alias("seen"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    domain, suffix = _levels(F.col("host"), two_labels)
    hosts = materialize(hosts.select("host", "seen", "bad", domain.alias("domain"), suffix.alias("suffix")))  # the pages are read once for all that follows
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0) + 1.0) / ((total["seen"] or 0) + 2.0)
    over, mid, low = (_strength(x, rate) for x in (suffixes, domains, hosts))
    suffixes = suffixes.select("suffix", ((F.col("bad") + over * rate) / (F.col("seen") + over)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("bad") + mid * F.col("suffix_rate")) / (F.col("seen") + mid)).alias("domain_rate"))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "seen", "bad", (F.col("bad") + low * F.col("domain_rate")).alias("alpha"), (F.col("seen") - F.col("bad") + low * (1 - F.col("domain_rate"))).alias("beta"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, max_bad: float = 0.5, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bound: every page, judged by the longest rule that fits, else
    blocked if the lower bound of its host's rate of bad pages (mean - z deviations of the posterior) is over `max_bad`.

    A rule fits its host and all its subdomains if the path starts with the rule's. Null urls have the empty host.
    Repeated rows stay; a null page_id has no label. Hosts join their posteriors by a plain equi-join, whose hot keys
    adaptive execution splits. Extra columns are not read; empty tables give no rows.
    """
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    scored = host_posteriors(pages, labels, two_labels).select(F.col("host").alias("known"), bound.alias("bad_bound"))
    host, path = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    joined = own.join(scored, F.col("host") == F.col("known"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    for say, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_bound")
