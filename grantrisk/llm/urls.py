"""URL filter: host rules first, then an empirical-Bayes host reputation.

Each labelled page is a good or bad outcome of its host.  Counts are shrunk
down a chain of beta-binomial priors -- all pages -> public suffix ->
registered domain -> host -- whose strengths are estimated from the counts by
the method of moments.  A host is blocked when even the upper bound of its
posterior odds of good pages lies below a share of the odds over all pages,
so hosts with few pages fall back on their domain and suffix and are never
blocked by chance.

Pages get their outcome from labelled documents whose lines they show.

All steps are DataFrame expressions.  Outcomes are counted per host before
anything else, with map-side partial counts, so a host with a third of all
pages is one row per task; the host table is joined back by a plain equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, staged

#: Paragraphs of fewer characters say nothing about where a page's text is from.
LEAST_PARAGRAPH = 20
#: A host is blocked below this share of the odds of all pages.
ODDS = 1 / 3

#: Suffixes of two labels under which names are registered (fixed values; a parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za", "com.cn")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains and a path prefix, written ``host/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lowered; '' without a scheme or for NULL."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; '' without a scheme or for NULL."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else NULLs; of equally long ones the first listed wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def name_of(host: Column) -> Column:
    """The host without user part, port and trailing dots: what reputations are kept for."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "\\.*(:[0-9]*)?$", "")


def _is_address(name: Column) -> Column:
    """IPv4 addresses and bracketed IPv6 ones, which have no domain above them."""
    return name.rlike(r"^([0-9]+\.){3}[0-9]+$") | name.startswith("[")


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Public suffix: the last label, or the last two where these are a known suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(_is_address(host), host).when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more."""
    return F.when(_is_address(host), host).when(F.substring_index(host, ".", -2).isin(*two_label), F.substring_index(host, ".", -3)) \
        .otherwise(F.substring_index(host, ".", -2))


def prior_strength(groups: DataFrame, least: float, most: float) -> float:
    """Moment estimate of a prior's strength from group counts (n, k).

    With p the pooled rate and q the spread of the group rates beyond what
    binomial noise explains, the strength is p(1-p)/q - 1, held within
    [least, most]; without spread (or with one group) it is ``most``.
    """
    s = groups.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kkn"), F.count("*").alias("m")).first()
    if s.m < 2:
        return most
    p = s.k / s.n
    spread = (s.kkn - p * s.k - (s.m - 1) * p * (1 - p)) / (s.n - s.nn / s.n)
    return min(max(p * (1 - p) / spread - 1, least), most) if spread > 0 else most


def host_reputation(outcomes: DataFrame, host: str = "host", good: str = "good", z: float = 1.645,
                    least_strength: float = 2.0, most_strength: float = 1000.0) -> DataFrame:
    """Posterior per host -> (host, n, k, domain, suffix, mean, lower, upper, base).

    ``outcomes`` has a row per labelled page: its host and ``good`` (boolean;
    NULL means not labelled and counts nowhere).  Hosts are taken without user
    part and port.  ``base`` is the rate over all pages, ``mean`` that of the
    posterior beta(a, b); the bounds are the nearer ones of two normal
    approximations, of the rate itself and of its log-odds (ln(a / b) -/+ z *
    sqrt(1 / a + 1 / b)), which fail at opposite ends.  Hosts without a labelled page are kept
    with n = 0 and get the prior.
    """
    counts = outcomes.groupBy(name_of(F.coalesce(F.col(host), F.lit(""))).alias("host")).agg(
        F.count(F.col(good)).cast("double").alias("n"), F.sum(F.when(F.col(good), 1.0).otherwise(0.0)).alias("k"))
    counts = staged(counts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    p0 = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).first()[0]
    s1, s2, s3 = (prior_strength(g, least_strength, most_strength) for g in (suffixes, domains, counts))
    suffixes = suffixes.select("suffix", ((F.col("k") + s1 * p0) / (F.col("n") + s1)).alias("sm"))
    domains = domains.join(suffixes, "suffix") \
        .select("domain", ((F.col("k") + s2 * F.col("sm")) / (F.col("n") + s2)).alias("dm"))
    a, b = F.col("k") + s3 * F.col("dm"), F.col("n") - F.col("k") + s3 * (1 - F.col("dm"))
    middle, sd = F.log(a / b), F.sqrt(1 / a + 1 / b)
    mean, rate_sd = a / (a + b), F.sqrt(a * b / (a + b + 1)) / (a + b)
    return counts.join(domains, "domain").select(
        "host", "n", "k", "domain", "suffix", mean.alias("mean"),
        F.greatest(mean - z * rate_sd, 1 / (1 + F.exp(z * sd - middle))).alias("lower"),
        F.least(mean + z * rate_sd, 1 / (1 + F.exp(-z * sd - middle))).alias("upper"), F.lit(p0).alias("base"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], url: str = "url", z: float = 1.645,
                odds: float = ODDS) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict and the host's posterior mean and upper bound.

    ``outcomes``: (host, good) rows, see ``host_reputation``.  The longest
    fitting rule decides; without one a host is blocked if the upper bound of
    its odds of good pages is below ``odds`` times those of all pages.  A host
    that ``outcomes`` doesn't have is allowed, with NULL bounds.  NULL urls
    and urls without a scheme have the empty host and path, which no rule
    fits.  Repeated rows stay; no pages give no rows.  Columns of these names
    in ``pages`` are replaced.
    """
    p = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url).alias("u"))
    p = p.select("row", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).withColumn("name", name_of(F.col("host")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = host_reputation(outcomes, z=z).select(F.col("host").alias("name"), "mean", "upper", "base")
    least = odds * F.col("base") / (odds * F.col("base") + 1 - F.col("base"))
    out = p.join(seen, "name", "left").withColumns({
        "rule": text,
        "verdict": F.coalesce(verdict, F.when(F.col("upper") < least, "block").otherwise("allow"))})
    new = ["host", "path", "rule", "verdict", "mean", "upper"]
    return out.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in new], *new)


def _paragraphs(pieces: Column) -> Column:
    """Pieces of text with runs of white space as one space, those of LEAST_PARAGRAPH characters and more."""
    plain = F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D\x20]+", " ")))
    return F.filter(plain, lambda x: F.length(x) >= LEAST_PARAGRAPH)


def page_paragraphs(html: Column) -> Column:
    """Texts between the tags of a page, its five commonest entities resolved; NULL for a NULL page."""
    def resolved(x: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return x

    return _paragraphs(F.transform(F.split(html, "<[^>]*>"), resolved))


def outcomes_of(pages: DataFrame, documents: DataFrame, labels: DataFrame, quality: str = "quality", url: str = "url", html: str = "html",
                text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(host, good) of every page; NULL unless labelled documents hold at least half of its paragraphs' characters.

    A paragraph counts with the share of good (1) ones among the labelled
    documents that hold it as a line; a page is good if the mean over its
    known characters is at least a half.  Lines meet paragraphs by a digest
    of 128 bits, each different line once, so a line that many documents
    share is one row.
    """
    def digest(line: Column) -> Column:
        return F.unhex(F.md5(line.cast("binary")))

    known = labels.where(F.col(quality).isNotNull()).select(F.col(id_col).alias("id"), F.col(quality).cast("double").alias("q"))
    held = documents.select(F.col(id_col).alias("id"), F.array_distinct(F.transform(_paragraphs(F.split(text, "\n")), digest)).alias("keys"))
    # only digests are moved, never texts
    lines = held.where(F.size("keys") > 0).join(known, "id").select(F.explode("keys").alias("key"), "q") \
        .groupBy("key").agg(F.avg("q").alias("rate"))
    sized = F.transform(page_paragraphs(F.col(html)), lambda x: F.struct(digest(x).alias("key"), F.length(x).cast("double").alias("size")))
    rows = staged(pages.select(F.monotonically_increasing_id().alias("page"), host_of(F.col(url)).alias("host"), sized.alias("p")), "page-paragraphs")
    each = rows.select("page", F.explode("p").alias("p")).select("page", "p.key", "p.size")
    sums = each.join(lines, "key", "left").groupBy("page").agg(
        F.sum("size").alias("all"), F.sum(F.when(F.col("rate").isNotNull(), F.col("size"))).alias("seen"),
        F.sum(F.col("size") * F.col("rate")).alias("good"))
    enough = F.col("seen") * 2 >= F.col("all")
    return rows.select("page", "host").join(sums, "page", "left") \
        .select("host", F.when(enough, F.col("good") * 2 >= F.col("seen")).alias("good"))

