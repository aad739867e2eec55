"""URL filtering by host rules and by association rules mined from labels.

A host rule names a host and the start of a path; it covers the host's subdomains, and the longest rule that fits
decides. URLs without such a rule are judged by token combinations: Spark's FP-growth mines the tokens (host labels,
path words, query keys, file endings) of labelled URLs together with the label, combinations are kept by support and
confidence, and a rule goes if a part of it is as confident. Every rule stands in an inverted index under its rarest
token; a URL looks up its tokens and is blocked if it holds all tokens of a rule it finds.

All labelled rows are mined; the number of rules is bounded by the support, not by the rows. Null URLs and those
without ``://`` have an empty host and path and no tokens, so they are allowed. Rows are judged one by one; ids may be
null or repeated. Without labels, or if no rule is confident, every URL without a host rule is allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import lower_ascii, query, table, whole
from flowmarrow.session import frozen

#: (verdict, host/path) of the host rules.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
BLOCK = "label=block"
#: Rules that are sent to all executors at most; more are joined by shuffle.
BROADCAST_RULES = 100_000


def _rest(url: Column) -> Column:
    at = F.instr(whole(url), "://")
    return F.when(at > 0, F.substring(whole(url), at + 3, F.length(whole(url)))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; digits in them read as 0, so running numbers are one token."""
    host, path = host_of(url), path_of(url)
    plain = lambda c: F.regexp_replace(lower_ascii(c), "[0-9]+", "0")
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), plain(x)))
    labels = F.split(host, r"\.")
    domain = F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
    query_keys = F.transform(F.split(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    scheme = F.array(F.regexp_extract(whole(url), r"^([A-Za-z]+)://", 1))
    return F.array_distinct(F.concat(
        named("host=", labels), named("domain=", domain), named("path=", F.split(path, "[/._-]+")),
        named("key=", query_keys), named("end=", ending), named("scheme=", scheme),
    ))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) for the pages that have a label: bad if any label says low quality or toxic."""
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    )
    p = pages.select(F.col("page_id").alias("id"), tokens_of(F.col("url")).alias("tokens"))
    return p.join(bad.where("bad IS NOT NULL"), "id").select("tokens", (F.col("bad") == 1).alias("bad"))


def mine(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, support): combinations that mark bad URLs, without those that a part replaces."""
    baskets = examples.where(F.size("tokens") > 0).select(
        F.when(F.col("bad"), F.array_append("tokens", BLOCK)).otherwise(F.col("tokens")).alias("items")
    )
    baskets = frozen(baskets, "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
    found = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    found = frozen(found.withColumn("rule_id", F.md5(F.array_join("tokens", "\n"))), "url-rules")
    # each rule meets only the rules that share its parts, by way of the part itself
    part = found.where(F.size("tokens") <= 12).select("rule_id", "confidence", F.explode(_parts("tokens")).alias("tokens"))
    better = part.join(found.select("tokens", F.col("confidence").alias("as_good")), "tokens").where("as_good >= confidence")
    return found.join(better.select("rule_id").distinct(), "rule_id", "left_anti")


def _parts(name: str) -> Column:
    """All proper, non-empty parts of a short sorted array."""
    size = F.size(name)
    picks = F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 1)
    part = lambda m: F.filter(F.col(name), lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return F.filter(F.transform(picks, part), lambda x: F.size(x) < size)


def index(rules: DataFrame, examples: DataFrame) -> DataFrame:
    """(token, tokens): every rule under its rarest token."""
    counts = examples.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keys = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    return keys.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("key"), F.first("tokens").alias("tokens")).select("key.token", "tokens")


def matched(urls: DataFrame, inverted: DataFrame) -> DataFrame:
    """The distinct URLs, of a column ``url``, that hold all tokens of a rule."""
    inverted = inverted.select("token", F.col("tokens").alias("needed"))
    if inverted.count() <= BROADCAST_RULES:
        inverted = F.broadcast(inverted)
    seen = urls.select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    seen = seen.select("url", "tokens", F.explode("tokens").alias("token")).join(inverted, "token")
    return seen.where(F.size(F.array_except("needed", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = HOST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    examples = frozen(labelled(pages, labels), "url-examples")
    inverted = frozen(index(mine(examples), examples), "url-index")
    bad = frozen(matched(pages, inverted).withColumnRenamed("url", "bad_url"), "url-matches")
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("found", host_rule(F.col("host"), F.col("path"), rules)).join(bad, p.url == bad.bad_url, "left")
    own = F.when(F.col("bad_url").isNotNull(), "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"))


@query()
def op4_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
