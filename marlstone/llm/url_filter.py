"""URL filters: allow and block rules first, then empirical-Bayes reputation of hosts for what no rule decides.

Labelled pages are outcomes, bad or not, of their host. A host's share of bad pages is a beta-binomial posterior whose prior
is centred on its registered domain's, the domain's on its suffix's, and the suffix's on the share of all. How strongly a
level is drawn to the one above is estimated from the spread of the level's shares around their parents' (the intraclass
correlation by analysis of variance). A page is blocked where even the lower posterior bound of its host reaches LIMIT.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import join_sized, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked when mean - SIGMAS * deviation of its posterior share of bad pages is LIMIT or more.
LIMIT, SIGMAS = 0.5, 1.645
#: The intraclass correlation is held within these bounds; the first is also taken where it can't be estimated.
LEAST_RHO, MOST_RHO = 0.01, 0.9
#: Suffixes of two labels under which names are registered (fixed values); all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of ``url``; both empty for null and where there is no ``://``."""
    at = lambda g: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g), F.lit(""))
    return F.translate(at(1), UPPER, LOWER), at(2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls where none does. Rules are code, so they become one expression."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of ``host``. A bare suffix and a name of one label are their own domain."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page is bad when its label is toxic or of poor quality, good when what is known of it is neither. Of
    repeated labels the worst counts; rows without an id or any label are no outcome."""
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))  # nulls are passed over
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("page_id is not null and bad is not null")
    return known.groupBy("page_id").agg(F.max("bad").alias("bad"))


def _concentration(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One row, ``s``: trials that the parent's share counts for in its children's posteriors. ``children`` (n, k, pn, pk) with
    their parent's counts; ``parents`` (n). Only those with outcomes count."""
    n, share, of = F.col("n"), F.col("k") / F.col("n"), F.col("pk") / F.col("pn")
    c = children.where("n > 0").agg(
        F.sum("n").cast("double").alias("all"), F.count(F.lit(1)).alias("c"), F.sum(n * (share - of) * (share - of)).alias("between"),
        F.sum(n * share * (1 - share)).alias("within"), F.sum(n * n / F.col("pn")).alias("sizes"),
    )
    both = c.crossJoin(F.broadcast(parents.where("n > 0").agg(F.count(F.lit(1)).alias("p"))))  # one row by one row
    free = F.col("c") - F.col("p")
    msb, msw = F.col("between") / free, F.col("within") / (F.col("all") - F.col("c"))
    size = (F.col("all") - F.col("sizes")) / free
    rho = F.when((free > 0) & (F.col("all") > F.col("c")) & (msb + (size - 1) * msw > 0), (msb - msw) / (msb + (size - 1) * msw))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(LEAST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return both.select(((1 - rho) / rho).alias("s"))


def reputations(counted: DataFrame) -> DataFrame:
    """(host, rows, mean, bound) of ``counted`` (host, rows, n, k): pages, outcomes and bad ones of each host. ``bound`` is the
    lower posterior bound of the share of bad pages.

    Each level is joined to the one above by its key, keys of very many children split over salts; of each level only one
    row of sums is broadcast.
    """
    domain, suffix = levels(F.col("host"))
    hosts = stored(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    up = lambda df, key: df.groupBy(key, *(["suffix"] if key == "domain" else [])).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = stored(up(hosts, "domain"), "domains")
    suffixes = stored(up(domains, "suffix"), "suffixes")
    whole = suffixes.agg(F.count(F.lit(1)).alias("children"), F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("k"), F.lit(0)).alias("pk"))  # one row

    def below(children: DataFrame, parents: DataFrame, key: str, own: str) -> DataFrame:
        """``children`` with ``mean`` and the weight ``s`` of their parent's; ``parents`` (key, children, n, k, mean)."""
        p = parents.select(key, F.col("children").alias("_of"), F.col("n").alias("pn"), F.col("k").alias("pk"), F.col("mean").alias("prior"))
        both = join_sized(children, p, key, "_of", F.xxhash64(own), "inner").drop("_of")
        return posterior(both, _concentration(both, parents))

    def posterior(both: DataFrame, s: DataFrame) -> DataFrame:
        got = both.crossJoin(F.broadcast(s))  # one row
        return got.withColumn("mean", (F.col("s") * F.col("prior") + F.col("k")) / (F.col("s") + F.col("n")))

    top = suffixes.crossJoin(F.broadcast(whole.select("pn", "pk", ((F.col("pk") + 0.5) / (F.col("pn") + 1)).alias("prior"))))
    top = stored(posterior(top, _concentration(top, whole.select(F.col("pn").alias("n")))).select("suffix", "children", "n", "k", "mean"), "top")
    middle = stored(below(domains, top, "suffix", "domain").select("domain", "children", "n", "k", "mean"), "middle")
    low = below(hosts, middle, "domain", "host")
    trials = F.col("s") + F.col("n")
    bound = F.col("mean") - SIGMAS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (trials + 1))
    return low.select("host", "rows", "mean", F.greatest(bound, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, known: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) of every row of ``pages``; ``known`` (page_id, bad) are outcomes.

    The longest rule that fits decides; else the reputation of the host: ``block`` where its ``bad_bound`` is LIMIT or more. A
    null url has an empty host and path, and the reputation of the empty host. A null id has no outcome; repeated ids are
    judged row by row, each row an outcome. Without outcomes, or for an empty table, nothing is blocked but by rules. Other
    columns of ``pages`` aren't read.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    labelled = rows.select("page_id", "host").join(known, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("k"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
    counted = sizes.join(labelled, "host", "left").select("host", "rows", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    # Stored, so that the join below can split hosts of very many pages.
    known_hosts = stored(reputations(counted).select("host", "rows", "bound"), "reputations")
    out = join_sized(rows, known_hosts, "host", "rows", F.xxhash64("page_id", "path"))
    by_host = F.when(F.col("bound") >= LIMIT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bound", 6).alias("bad_bound"))
