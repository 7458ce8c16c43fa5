"""URL filters: listed rules, then association rules mined by FP-growth.

Labelled URLs are item sets of URL tokens and, for bad ones, a mark. FP-growth
finds the frequent sets; rules from tokens to the mark that reach a confidence
and a support, and that no shorter rule covers, are kept. A rule is indexed
under its rarest token, so a URL tries only the rules of its own tokens. All
of it is DataFrame functions; judging URLs takes no shuffle.
"""

from __future__ import annotations

import math
import string
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwatch.llm.common import cut, read

LISTED = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SUPPORT = 0.002
#: Examples that a rule must rest on, however few there are in all.
LEAST = 25
CONFIDENCE = 0.5
_MARK = "bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end. Else both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (host and path in one string) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        on = (host == name) | host.endswith("." + name)
        fits.append(F.when(on & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels, path words, query keys and whether it has a fragment; digits are one."""
    url = F.coalesce(url, F.lit(""))
    words = lambda x, mark: F.transform(F.split(F.lower(x), r"[^\p{L}\p{N}_-]+"), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, r"\d+", "0")))
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda w: F.concat(F.lit("q:"), F.lower(F.regexp_extract(w, r"\A([^=]*)", 1))))
    every = F.concat(F.transform(F.split(host, r"\."), lambda w: F.concat(F.lit("h:"), w)), words(path, "p:"), keys, F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda t: F.length(t) > 2))


def mine_rules(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, fewest: int = LEAST) -> list[tuple[list[str], float]]:
    """All rules (tokens, confidence) from (tokens, bad) rows that no rule of fewer tokens covers.

    Support is a share of all examples, `fewest` of them at least. Examples without tokens or label are
    passed over. Tokens that are rules by themselves do not enter mining, as no longer rule holds one,
    and tokens of the same examples enter as one. Found rules come one by one, the short ones first.
    A rule's tokens go from the rarest on.
    """
    rows = examples.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select("tokens", "bad")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return []
    least = math.ceil(max(support * n, fewest))
    if bad < least:
        return []
    tokens = rows.select("row", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    rates = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("m"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("y"))
    rates = cut(rates.where(F.col("m") >= least).withColumn("c", F.col("m") / F.col("n")))
    seen: dict[str, int] = {}
    kept: dict[frozenset, float] = {frozenset([r.token]): r.c for r in rates.where(F.col("c") >= confidence).toLocalIterator()}
    alike = cut(rates.where(F.col("c") < confidence).groupBy("n", "m", "x", "y").agg(F.min("token").alias("token"), F.sort_array(F.collect_list("token")).alias("all")))
    sets = tokens.join(alike.select("token"), "token").groupBy("row", "bad").agg(F.collect_list(F.concat(F.lit("t"), "token")).alias("items"))
    sets = cut(sets.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(_MARK))).otherwise(F.array().cast("array<string>"))).alias("items")))
    count = sets.count()
    if count:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / count, minConfidence=confidence).fit(sets)
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(_MARK))).select("antecedent", "confidence")
        longer: dict[frozenset, float] = {}
        under: dict[str, list[frozenset]] = {}
        for r in found.orderBy(F.size("antecedent"), F.array_join(F.sort_array("antecedent"), " ")).toLocalIterator():
            have = frozenset(t[1:] for t in r.antecedent)
            if have and not any(rule <= have for t in have for rule in under.get(t, ())):
                longer[have] = r.confidence
                under.setdefault(min(have), []).append(have)
        if longer:
            same, seen = {}, {}
            for r in alike.toLocalIterator():
                same[r.token] = r.all
                seen |= dict.fromkeys(r.all, r.n)
            kept |= {frozenset(one): c for rule, c in longer.items() for one in product(*(same[t] for t in rule))}
    return sorted(((sorted(rule, key=lambda t: (seen.get(t, 0), t)), c) for rule, c in kept.items()), key=lambda r: (len(r[0]), -r[1], r[0]))


def matches(tokens: Column, rules: list[tuple[list[str], float]]) -> Column:
    """Whether a URL with these tokens has all tokens of a rule; rules are looked up by their first token, the rarest."""
    index: dict[str, list[list[str]]] = {}
    for rule, _ in rules:
        index.setdefault(rule[0], []).append(rule)
    if not index:
        return F.lit(False)
    lists = F.create_map(*[x for t, own in index.items() for x in (F.lit(t), F.array(*[F.array(*map(F.lit, r)) for r in own]))])
    return F.exists(tokens, lambda t: F.coalesce(F.exists(F.try_element_at(lists, t), lambda r: F.size(F.array_except(r, tokens)) == 0), F.lit(False)))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED, **mining) -> DataFrame:
    """The given rows (page_id, url and others) with host, path, rule and verdict.

    A listed rule decides; else the URL is blocked if a mined rule matches and
    allowed if none does. labels (page_id, bad) can lack pages or hold nulls.
    A null url, or one without ://, has an empty host and path and is allowed.
    """
    host, path = host_and_path(F.col("url"))
    tokens = url_tokens(F.col("url"), host, path)
    known = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
    examples = pages.select("page_id", tokens.alias("tokens")).join(known, F.col("page_id") == F.col("_id")).select("tokens", "bad")
    mined = mine_rules(examples, **mining)
    other = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    method = F.when(matches(tokens, mined), "block").otherwise("allow")
    judged = pages.select(F.struct(*[pages[c] for c in other]).alias("_row"), host.alias("host"), path.alias("path"), method.alias("_method"))
    judged = judged.withColumn("_rule", listed_rule(F.col("host"), F.col("path"), rules))
    return judged.select(*[F.col("_row")[c].alias(c) for c in other], "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_method").alias("verdict"))


def op3_url_rules(spark, sf_dir) -> DataFrame:
    """Verdicts of every page's url; labels of the page's id tell bad ones: quality 0 or toxic 1."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")
