"""URL filter with DataFrame functions and Spark's FP-growth: path rules first, then mined association rules.

A URL becomes a set of tokens (host labels, path words, query names, scheme). FP-growth finds token combinations
in the labelled pages; those whose share of blocked pages is high enough become rules. Rules are matched through an inverted
index: a page meets a rule by the rule's rarest token, and the rule holds if the page has all of its tokens.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import checked

# Share of labelled pages a combination needs, share of blocked pages among those it fits.
SUPPORT, CONFIDENCE = 0.002, 0.6
# Pages of one combination that must be labelled, at least.
LEAST_PAGES = 10
# A page is junk if runs of signs are more than this share of its words, or if of so many words fewer than this share are distinct.
NOISY_SHARE, REPEATED_WORDS, DISTINCT_SHARE = 0.2, 40, 0.2
# --- Fixed values: words that mark the text of a page as spam. ---
SPAM_WORDS = ("casino", "jackpot", "poker", "bets", "betting", "sportsbook", "pills", "viagra", "cialis")


class PathRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# --- Fixed values: the rules of the contract, in its order. ---
PATH_RULES = (
    PathRule("allow", "com", "/"),
    PathRule("block", "example.com", "/en/"),
    PathRule("allow", "www.example.com", "/en/"),
    PathRule("block", "net", "/es/"),
    PathRule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL column; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, r"(?s)\A[^?#]*", 0)


def path_rule(host, path, rules: tuple[PathRule, ...] = PATH_RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls where none does. Of equally long ones the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: -len(r.text))[::-1]:
        fits = ((host == one.host) | host.endswith("." + one.host)) & path.startswith(one.path)
        rule, verdict = F.when(fits, one.text).otherwise(rule), F.when(fits, one.verdict).otherwise(verdict)
    return rule, verdict


def tokens_of(url) -> F.Column:
    """Distinct tokens of a URL, each with its part: scheme, host labels, path words and query names; numbers count as ``#``."""
    host, path = split_url(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    plain = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    parts = (("scheme", F.array(scheme)), ("host", F.split(host, r"\.")), ("path", F.split(plain, "[^a-z0-9#]+")), ("query", F.transform(F.split(F.lower(query), "&"), lambda q: F.regexp_extract(q, "^[^=]*", 0))))
    named = [_named(part, words) for part, words in (*parts, ("word", F.split(host, "[.-]")))]
    return F.array_distinct(F.concat(*named))


def _named(part: str, words) -> F.Column:
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(f"{part}="), w))


def shows_spam(html) -> F.Column:
    """Whether the whole text of a page shows spam or junk; null without html. Scripts, styles, comments and tags are left out.

    Evidence is a spam word, runs of signs at many of the words, or few distinct words in a text of some length.
    """
    text = F.lower(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "))
    text = F.regexp_replace(text, "&amp;", "&")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    noisy = F.regexp_count(text, F.lit(r"[!#$%&*]{2,}"))
    spam = text.rlike(r"(?<![a-z])(" + "|".join(SPAM_WORDS) + r")(?![a-z])")
    return spam | (noisy > NOISY_SHARE * F.size(words)) | ((F.size(words) >= REPEATED_WORDS) & (F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words)))


def mine(pages: DataFrame, url: str = "url", blocked: str = "blocked", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, confidence, pages) from labelled ``pages``; rows without a label or URL are left out.

    FP-growth runs over all blocked pages, and all labelled pages count; a rule is a token set whose share of blocked pages
    is at least ``confidence``. Sets that hold a smaller rule of the same or higher confidence are pruned.
    """
    given = pages.where(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(F.array_sort(tokens_of(F.col(url))).alias("items"), F.col(blocked).cast("boolean").alias("b"))
    given = stage(given.where(F.size("items") > 0), "url-items")
    rows, bad_rows = given.agg(F.count("*"), F.count_if("b")).first()
    if not bad_rows:
        return pages.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, pages long")
    least = max(LEAST_PAGES * confidence, support * rows * confidence)
    kinds, alike = _kinds(given, least)
    # Blocked pages alone are mined: a rule must be frequent among them, and they are the fewer. Hot kinds are dealt in parts.
    parts = kinds.where("bad > 0").select("items", "bad", F.explode(F.expr("sequence(0L, (bad - 1) div 10000)")).alias("part")).repartition("items", "part")
    bad = parts.select("items", F.explode(F.expr("array_repeat(0, int(least(10000L, bad - 10000 * part)))")).alias("one")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / bad_rows), minConfidence=1.0).fit(bad)
    sets = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad"))
    # Whether a set is a rule takes its share over all labelled pages: counted through the same index that matching uses.
    sets = stage(sets.where(F.col("bad") >= least), "url-sets").withColumn("rule_id", F.xxhash64("tokens"))
    met = fitting(kinds, sets.select("rule_id", "tokens"), "kind", "items", "n")
    counted = met.groupBy("rule_id").agg(F.sum("n").alias("pages"))
    rules = sets.join(counted, "rule_id").withColumn("confidence", F.col("bad") / F.col("pages")).where((F.col("confidence") >= confidence) & (F.col("pages") >= max(LEAST_PAGES, support * rows)))
    rules = _pruned(stage(rules.select("rule_id", "tokens", "confidence", "pages"), "url-rules"))
    return stage(_written_out(rules, alike), "url-rules")


def _kinds(given: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Labelled pages by the tokens that are frequent among blocked ones: (kind, items, n, bad), and (token, first) of tokens alike.

    Tokens that the same pages have are one, named by the first: a set with two of them has a smaller one of the same pages.
    """
    urls = stage(given.groupBy("items").agg(F.count("*").alias("n"), F.count_if("b").alias("bad")), "url-counts")
    spread = urls.select("items", "n", "bad", F.explode("items").alias("token"))
    used = checked(stage(spread.groupBy("token").agg(F.sum("bad").alias("of")).where(F.col("of") >= least).select("token"), "url-tokens"))
    kept = spread.join(used, "token").groupBy("items").agg(F.array_sort(F.collect_list("token")).alias("kept"), F.first("n").alias("n"), F.first("bad").alias("bad"))
    full = stage(kept.groupBy("kept").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("kind", F.array_join("kept", " ")), "url-full")
    own = full.select("kind", F.explode("kept").alias("token"))
    where = own.groupBy("token").agg(F.count("*").alias("of"), *(F.bit_xor(F.xxhash64("kind", F.lit(i))).alias(f"d{i}") for i in (1, 2)))
    alike = where.groupBy("of", "d1", "d2").agg(F.min("token").alias("first"), F.collect_list("token").alias("all"))
    alike = checked(stage(alike.select("first", F.explode("all").alias("token")), "url-alike"))
    firsts = own.join(alike, "token").groupBy("kind").agg(F.array_sort(F.collect_set("first")).alias("items"))
    return stage(firsts.join(full.select("kind", "n", "bad"), "kind"), "url-kinds"), alike


def _written_out(rules: DataFrame, alike: DataFrame) -> DataFrame:
    """``rules`` with every choice of tokens that are alike to the first ones they name."""
    groups = alike.groupBy("first").agg(F.collect_list("token").alias("all"))
    named = rules.select("confidence", "pages", "rule_id", F.explode("tokens").alias("first")).join(groups, "first").groupBy("rule_id", "confidence", "pages").agg(F.collect_list("all").alias("choices"))
    empty = F.array(F.array().cast("array<string>"))
    longer = lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.array_append(d, t))))
    written = named.select("confidence", "pages", F.explode(F.aggregate("choices", empty, longer)).alias("tokens")).withColumn("tokens", F.array_sort("tokens"))
    return written.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "pages")


def _pruned(rules: DataFrame) -> DataFrame:
    """``rules`` without those that hold a smaller rule of the same or higher confidence.

    Sets without one token are looked up first, by equality: every subset of a rule that is as sure is itself a rule, so what
    this leaves out has a smaller rule among what stays. The few that stay are then met with each other through the index.
    """
    less = rules.where(F.size("tokens") > 1).select("rule_id", "confidence", F.explode("tokens").alias("token"), "tokens").withColumn("inner", F.array_remove("tokens", F.col("token")))
    smaller = rules.select(F.col("tokens").alias("inner"), F.col("confidence").alias("inner_confidence"))
    over = less.join(smaller, "inner").where(F.col("inner_confidence") >= F.col("confidence")).select("rule_id").distinct()
    left = stage(rules.join(over, "rule_id", "left_anti"), "url-pruned")
    pairs = fitting(left.select(F.col("rule_id").alias("outer"), "tokens"), left, "outer", "tokens").where(F.col("outer") != F.col("rule_id"))
    sure = left.select("rule_id", "confidence")
    met = pairs.join(sure.withColumnRenamed("confidence", "inner_confidence"), "rule_id").join(sure.select(F.col("rule_id").alias("outer"), "confidence"), "outer")
    over = met.where(F.col("inner_confidence") >= F.col("confidence")).select(F.col("outer").alias("rule_id")).distinct()
    return stage(left.join(over, "rule_id", "left_anti"), "url-rules")


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, rule_id, tokens): every rule under its rarest token, the one in the fewest rules."""
    spread = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("uses"))
    rarest = spread.join(common, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("uses", "token")).alias("token"), F.first("tokens").alias("tokens"))
    return rarest.select("token", "rule_id", "tokens")


def fitting(pages: DataFrame, rules: DataFrame, key: str, tokens: str, *others: str) -> DataFrame:
    """(key, rule_id, others) of every rule whose tokens a page has all, found by the rule's rarest token.

    The index is bounded by the number of rules and broadcast while it is small; else it is joined by a shuffle.
    """
    index = checked(stage(inverted_index(rules), "url-index").withColumnRenamed("tokens", "needed"))
    spread = pages.select(F.col(key), *others, F.col(tokens).alias("own"), F.explode(tokens).alias("token"))
    return spread.join(index, "token").where(F.size(F.array_except("needed", "own")) == 0).select(key, "rule_id", *others)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", path_rules: tuple[PathRule, ...] = PATH_RULES) -> DataFrame:
    """One row per row of ``pages``: host, path, rule, verdict, and of the mined rules the confidence of the surest that fits.

    A path rule decides where one fits; else a page is blocked if a mined rule fits it, and allowed if none does. Null URLs have
    empty host and path and are allowed. Pages of the same URL are judged once: rules are met by distinct URLs.
    """
    host, path = split_url(F.col(url))
    rule, verdict = path_rule(host, path, path_rules)
    urls = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("u")).distinct().withColumn("own", tokens_of(F.col("u")))
    met = fitting(urls, rules, "u", "own").join(checked(rules.select("rule_id", "confidence")), "rule_id")
    best = checked(stage(met.groupBy("u").agg(F.max("confidence").alias("block_confidence")), "url-met"))
    both = pages.select(F.col(key), F.col(url).alias("__url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("__rule_verdict")).join(best, F.col("__url") == F.col("u"), "left")
    mined = F.when(F.col("block_confidence").isNotNull(), "block").otherwise("allow")
    return both.select(key, "host", "path", "rule", F.coalesce("__rule_verdict", mined).alias("verdict"), "block_confidence")
