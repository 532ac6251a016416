"""URL filtering by fixed host and path rules and by mined token combinations, with DataFrame operations only.

``judge`` takes the longest fixed rule that fits a URL (host or any parent domain, path prefix). Where none fits, the
method decides: Spark's FP-growth mines combinations of URL tokens from labelled URLs; those whose confidence and support
for the label ``block`` reach the bounds, and that no subset already implies at equal or higher confidence, are block
rules. They are matched by an inverted index: a rule's rarest token is joined with the tokens of each distinct token set (not
each URL: a host that holds a third of all rows is matched once for each of its few token sets), and a rule whose tokens
are all there fires. URLs that nothing blocks are allowed.

Tokens: every domain suffix of the host (``h:``), its first label (``s:``), path parts without digits (``p:``), the
extension (``e:``), names of query parameters (``q:``) and whether there is a fragment (``f:``). Null URLs, and URLs
without ``://``, have an empty host and path and no tokens: allowed. Repeated rows get the same verdict. Empty labels mine
no rules; an empty table gives no rows. Only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK = "=block"


@dataclass(frozen=True)
class Mining:
    """Bounds of a mined rule: share of labelled URLs that it holds for, share of its URLs labelled block."""

    support: float = 0.002
    confidence: float = 0.6


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, both null without one; at equal length the first one listed."""
    text = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, sorted."""
    host, path = host_of(url), path_of(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, n), ".")))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.filter(F.split(rest, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=").getItem(0)))
    extension = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    found = F.concat(
        F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")),
        F.when(n > 1, F.array(F.concat(F.lit("s:"), labels.getItem(0)))).otherwise(F.array().cast("array<string>")),
        parts,
        names,
        F.when(extension != "", F.array(F.concat(F.lit("e:"), extension))).otherwise(F.array().cast("array<string>")),
        F.when(url.contains("#") & (host != ""), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def classes_of(sets: DataFrame, support: float) -> DataFrame:
    """(token, class, n) of the tokens of at least that share of the URLs, from distinct token sets and their numbers of URLs
    (tokens, urls); tokens that always stand together are one class, named by the first of them.

    There are at most (tokens a URL) / support of them, whatever the number of URLs.
    """
    held = sets.select(F.xxhash64("tokens").alias("x"), F.xxhash64("tokens", F.lit(1)).alias("y"), "urls", F.explode("tokens").alias("token"))
    found = held.groupBy("token").agg(F.sum("urls").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "xy"))
    least = sets.agg((F.sum("urls") * support).alias("least"))
    often = found.crossJoin(F.broadcast(least)).where("n >= least")
    named = often.groupBy("n", "x", "y").agg(F.min("token").alias("class"), F.collect_list("token").alias("tokens"))
    return named.select(F.explode("tokens").alias("token"), "class", "n")


def in_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, kinds): the classes of each distinct token set; sets without any are left out."""
    held = sets.select("tokens", F.explode("tokens").alias("token")).join(classes.select("token", "class"), "token")
    return held.groupBy("tokens").agg(F.array_sort(F.collect_set("class")).alias("kinds"))


def mine(labelled: DataFrame, bounds: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(rules, classes) from rows (url, blocked boolean): rules have rule_id, tokens (classes of tokens), confidence and
    support; rows with a null label don't count.

    Tokens that always stand together in labelled URLs are mined as one, so that a long path of one host makes one item, not
    every combination of its parts; a class stands in a URL that has any of its tokens.
    """
    known = labelled.where("blocked is not null").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    sets = known.groupBy("tokens").agg(F.count("*").alias("urls"))
    classes = classes_of(sets, bounds.support)
    none = F.array().cast("array<string>")
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(none)
    baskets = known.join(in_classes(sets, classes), "tokens", "left").select(F.concat(F.coalesce("kinds", none), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=bounds.support, minConfidence=bounds.confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK))
    rules = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = rules.withColumn("rule_id", F.xxhash64(F.array_join("tokens", " ")))
    # a rule that a part of its tokens implies as surely adds nothing: its parts are listed and looked up, not rules compared
    parts = F.aggregate("tokens", F.array(none), lambda sets, t: F.concat(sets, F.transform(sets, lambda x: F.concat(x, F.array(t)))))
    listed = rules.select("rule_id", "confidence", F.size("tokens").alias("m"), F.explode(parts).alias("part")).where("size(part) > 0 and size(part) < m")
    surer = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("surer"))
    implied = listed.join(surer, "part").where("surer >= confidence").select("rule_id").distinct()
    return rules.join(implied, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support"), classes


def match(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, rule_id, confidence): the surest rule that fires for each token set; sets without one are left out.

    A rule is indexed by its rarest class alone, and looked at for the sets that have it.
    """
    n = classes.groupBy("class").agg(F.max("n").alias("n"))
    listed = rules.select("rule_id", "confidence", F.col("tokens").alias("wanted"), F.explode("tokens").alias("class")).join(n, "class")
    index = listed.groupBy("rule_id", "confidence", "wanted").agg(F.min_by("class", F.struct("n", "class")).alias("class"))
    hits = in_classes(token_sets, classes).select("tokens", "kinds", F.explode("kinds").alias("class")).join(index, "class")
    fired = hits.where(F.size(F.array_except("wanted", "kinds")) == 0)
    return fired.groupBy("tokens").agg(F.max(F.struct("confidence", "rule_id")).alias("x")).select("tokens", "x.rule_id", "x.confidence")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, bounds: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every row; labelled: (url, blocked)."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    text, verdict = fixed_rule(host, path, rules)
    read = pages.select(F.col("page_id"), url, host.alias("host"), path.alias("path"), text.alias("rule"), verdict.alias("fixed"), tokens_of(url).alias("tokens"))
    open_sets = read.where("rule is null and size(tokens) > 0").select("tokens").distinct()
    fired = match(open_sets, *mine(labelled, bounds)).select("tokens", F.col("rule_id").alias("mined_rule"))
    joined = read.join(fired, "tokens", "left")
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """Labels: a page whose number is that of a labelled document is blocked if that is toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    blocked = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", blocked)
    return judge(pages, labelled)
