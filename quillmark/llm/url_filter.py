"""Which pages to keep by their urls: rules where there are any, else what is known of the pages' host.

A host's share of good pages is estimated from labelled pages by empirical Bayes: a beta-binomial prior for a host comes from the
other hosts of its registered domain, that domain's from the other domains of the public suffix, the suffix's from all others.
How much a level's members differ is itself estimated from the table. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.spread import attach
from quillmark.session import stored

#: A host is allowed if its share of good pages is at least ``LEAST``, but for a chance of about 5 % (``Z`` deviations).
LEAST, Z = 0.5, 1.645
#: Weight of a prior, in pages: where no level tells, and its bounds.
WEIGHT, WEIGHTS = 10.0, (0.5, 10_000.0)
# Labels that make up a public suffix together with a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "gob", "ne", "net", "nom", "or", "org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty for a url that is null or has no ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumns(
        {"host": F.translate(host, _UPPER, _LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    )


def _labels(host: Column) -> Column:
    """Labels of a host without user and port; those of an address are one label."""
    bare = F.rtrim(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), F.lit("."))
    return F.when(bare.rlike(r"^([0-9.]+|\[.*\]?)$"), F.array(bare)).otherwise(F.split(bare, r"\."))


def with_domain(hosts: DataFrame) -> DataFrame:
    """Add ``domain`` (registered) and ``suffix`` (public) to a table of hosts.

    A suffix is the last label, or the last two where a country's two letters follow a label like ``co``; a domain has one label
    more. A host of no more labels than its suffix, and an address, is its own domain.
    """
    labels = F.col("__labels")
    two = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.least(F.size(labels), F.lit(2)) * -1).isin(*SECOND_LEVEL)
    size = F.when(two & (F.size(labels) > 1), 2).otherwise(1)

    def last(n: Column) -> Column:
        taken = F.least(n, F.size(labels))
        return F.concat_ws(".", F.slice(labels, F.size(labels) - taken + 1, taken))

    return hosts.withColumn("__labels", _labels(F.col("host"))).withColumns({"domain": last(size + 1), "suffix": last(size)}).drop("__labels")


# --- Reputation ---------------------------------------------------------------


def _weight(groups: DataFrame) -> float:
    """How many pages a prior of mean ``p`` is worth for groups with ``good`` of ``n`` pages: moments of the beta-binomial."""
    n, k, p = F.col("n"), F.col("good"), F.col("p")
    spread = p * (1 - p)
    excess, most = F.sum((k - n * p) * (k - n * p) - n * spread), F.sum(n * (n - 1) * spread)
    row = groups.where("n > 0").agg(excess.alias("excess"), most.alias("most")).first()
    if not row["most"]:
        return WEIGHT
    likeness = row["excess"] / row["most"]  # the correlation of two pages of a group
    return min(max(1 / likeness - 1, WEIGHTS[0]), WEIGHTS[1]) if likeness > 0 else WEIGHTS[1]


def _others(outer: str, weight: float) -> Column:
    """Share of good pages among the others of the level above, drawn to that level's own prior."""
    good, n = F.col(f"{outer}_good") - F.col("good"), F.col(f"{outer}_n") - F.col("n")
    return (good + weight * F.col(f"{outer}_p")) / (n + weight)


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, domain, suffix, n_pages, good_share, bound) from (host, n_pages, n, good): pages, labelled ones, good ones.

    ``good_share`` is the mean and ``bound`` a lower bound of the posterior beta distribution: mean less `Z` deviations. A
    host without labelled pages has its prior. Without any label each share is a half.
    """
    hosts = stored(with_domain(hosts), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    others = (F.lit(total["good"]) - F.col("good") + 1) / (F.lit(total["n"]) - F.col("n") + 2)
    suffixes = stored(suffixes.withColumn("p", others), "suffixes")
    outer = suffixes.select("suffix", *[F.col(c).alias(f"suffix_{c}") for c in ("n", "good", "p")])
    domains = attach(domains, outer, "suffix").withColumn("p", _others("suffix", _weight(suffixes)))
    domains = stored(domains.select("domain", "n", "good", "p"), "domains")
    outer = domains.select("domain", *[F.col(c).alias(f"domain_{c}") for c in ("n", "good", "p")])
    near = stored(attach(hosts, outer, "domain").withColumn("p", _others("domain", _weight(domains))), "hosts")
    weight = _weight(near)
    a, b = F.col("good") + weight * F.col("p"), F.col("n") - F.col("good") + weight * (1 - F.col("p"))
    mean = a / (a + b)
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return near.select("host", "domain", "suffix", "n_pages", mean.alias("good_share"), bound.alias("bound"))


# --- Rules ----------------------------------------------------------------------


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a short list of rules."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(c) for x, c in zip(r, ("host", "path", "verdict"))]) for r in rules]
    one = spark.range(1)
    if not rows:
        return one.where("id < 0").select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    return one.select(F.inline(F.array(*rows)))


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): of each host with any, all rules of itself and of the hosts it is a subdomain of."""
    verdict = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("a rule's verdict must be allow or block, not "), F.coalesce("verdict", F.lit("NULL"))))
    )
    own = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("parent"),
        F.col("path").cast("string").alias("path"), verdict.cast("string").alias("verdict"),
    )
    # of equal rules the one that blocks
    once = own.groupBy("parent", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(
        (F.length("parent") + F.length("path")).alias("size"), F.length("parent").alias("depth"),
        F.concat("parent", "path").alias("rule"), "path", "verdict",
    )
    by_parent = once.groupBy("parent").agg(F.collect_list(rule).alias("own_rules"))
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    chains = stored(hosts.select("host", F.explode(parents).alias("parent")), "parents")
    found = attach(chains, by_parent, "parent", how="inner")
    return found.groupBy("host").agg(F.flatten(F.collect_list("own_rules")).alias("rules"))


# --- Verdicts --------------------------------------------------------------------


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_share, bound): allow or block each page by its url.

    A rule (host, path, verdict) fits a page of its host or of a subdomain whose path starts with the rule's. Of several the longest
    decides, of equally long ones that with the longer host. Else the page is allowed if its host's posterior bound is at least
    `LEAST`. ``outcomes`` (page_id, good 0/1; several rows of a page count each) are the labelled pages.

    Url null or without ``://``: host and path are empty, and the page is judged as one of host ''. Rules without host or path fit
    nothing; equal rules: the one that blocks. Null ids and repeated rows stay, one row for each. An empty table gives none. Further
    columns don't matter. Texts of pages aren't read.
    """
    own = with_host(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")))
    urls = stored(own.select("page_id", "host", "path"), "urls")
    counts = urls.groupBy("host").agg(F.count("*").alias("n_pages"))
    if outcomes is None:
        hosts = counts.withColumns({"n": F.lit(0).cast("bigint"), "good": F.lit(0).cast("bigint")})
    else:
        known = outcomes.where("page_id IS NOT NULL AND good IN (0, 1)").groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(
            F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("good")
        )
        # an id is one page, whatever its number of rows
        once = urls.where("page_id IS NOT NULL").groupBy("page_id").agg(F.min("host").alias("host"))
        labelled = once.join(known, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        hosts = counts.join(labelled, "host", "left").fillna(0, ["n", "good"])
    judged = stored(reputation(hosts), "reputation")
    table = stored(judged.join(_fitting(judged, rules), "host", "left"), "rules")
    both = attach(
        urls, table.select("host", "good_share", "bound", "rules"), "host", table.select("host", F.col("n_pages").alias("n"))
    )
    best = F.array_max(F.filter("rules", lambda r: F.startswith("path", r["path"])))
    own_verdict = F.when(F.col("bound") >= LEAST, "allow").otherwise("block")
    return both.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own_verdict).alias("verdict"),
        "good_share", "bound",
    )


def outcomes_of_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) of pages that show a labelled document: the last number in the path is its ``doc_id``, good its ``quality``."""
    shown = with_host(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1).try_cast("bigint")
    ids = stored(shown.select("page_id", number.alias("doc_id")).where("doc_id IS NOT NULL"), "shown")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("good")
    )
    return attach(ids, known, "doc_id", how="inner").select("page_id", "good")


def without_blocked(pages: DataFrame, rules: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Rows of ``pages`` whose urls aren't blocked, as they are: a verdict hangs on host and path alone."""
    verdicts = judge(pages.select("page_id", "url"), rules, outcomes)
    blocked = verdicts.where("verdict = 'block'").select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    at = with_host(pages.select(F.struct("*").alias("__row"), F.col("url").alias("__url")), "__url")
    kept = at.join(blocked, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left_anti")
    return kept.select("__row.*")
