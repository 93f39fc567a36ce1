"""URL filter by association rules mined with FP-growth.

A list of rules (host, path) judges the urls it fits; the longest fitting rule wins. Those verdicts
label their urls, and Spark's FP-growth mines the token combinations of labelled urls. Rules whose
consequent is a verdict, pruned by support and confidence and free of a more general rule that is as
sure, form an inverted index from token to rule; the urls no listed rule fits are matched through it,
and the surest matching rule decides. A url that nothing matches is allowed.

Tokens: the last one and two labels of the host, its first label; the first and the last path segment and
the whole path (digits folded to ``#``), the file ending, and the names of the parameters as one sorted set.
A url so has eight tokens at most, whatever its depth and parameters, and the item sets mined grow with the
urls and not with the power of what they share.

Defined results: a null url, or one without ``://``, has an empty host and path and no listed rule;
repeated rows are each judged; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.store import stored

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT = 0.005
CONFIDENCE = 0.8


def host_and_path(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def listed(rules=RULES):
    """(rule, verdict) columns of the longest rule that fits ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def tokens():
    labels = F.split("host", r"\.")
    last = F.element_at(labels, -1)
    pair = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    segments = F.filter(F.split(F.regexp_replace("path", r"\d+", "#"), "/"), lambda s: s != "")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)))
    tag = lambda kind, col: F.concat(F.lit(kind + ":"), col)
    found = F.array(
        tag("top", last), tag("site", pair), tag("first", F.element_at(labels, 1)),
        F.when(F.size(segments) > 0, tag("dir", F.get(segments, F.lit(0)))),
        F.when(F.size(segments) > 1, tag("leaf", F.get(segments, F.size(segments) - 1))),
        F.when(F.size(segments) > 1, tag("path", F.array_join(segments, "/"))),
        F.when(F.col("path").rlike(r"\.[A-Za-z0-9]+$"), tag("ext", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))),
        F.when(F.size(names) > 0, tag("args", F.array_join(names, "&"))),
    )
    return F.array_distinct(F.array_compact(found))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, items, label, confidence, support) from rows (items, label)."""
    verdict = F.concat(F.lit("verdict:"), "label")
    baskets = labelled.select(F.concat("items", F.array(verdict)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = stored(
        model.associationRules.where(F.col("consequent")[0].startswith("verdict:")).select(
            F.array_sort("antecedent").alias("items"),
            F.substring(F.col("consequent")[0], len("verdict:") + 1, 100).alias("label"),
            "confidence", "support",
        ),
        "rules",
    )
    # A rule goes when one of its parts already says the same as surely. The support bounds their number.
    wide = rules.select("label", F.col("items").alias("part"), F.col("confidence").alias("sure"), F.explode("items").alias("token"))
    longer = rules.select("label", "items", "confidence", F.explode("items").alias("token"))
    spare = (
        longer.join(wide, ["label", "token"])
        .where((F.size("part") < F.size("items")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
        .select("items", "label").distinct()
    )
    return rules.join(spare, ["items", "label"], "left_anti").withColumn("rule_id", F.xxhash64("items", "label"))


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict and what decided."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed(rules)
    urls = stored(
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .select("*", rule.alias("rule"), verdict.alias("listed"), F.monotonically_increasing_id().alias("row"))
        .withColumn("items", tokens()),
        "urls",
    )
    known = urls.where("listed is not null").select("items", F.col("listed").alias("label"))
    if known.isEmpty():
        mined = None
    else:
        mined = mine(known, support, confidence)
    open_ = urls.where("listed is null and host <> ''").select("items").distinct()
    if mined is None:
        found = urls.select("items", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("sure")).limit(0)
    else:
        # The inverted index: a rule fires when as many of its tokens are met as it has.
        index = mined.select("rule_id", "label", "confidence", F.size("items").alias("need"), F.explode("items").alias("token"))
        best = F.max(F.struct("confidence", "need", F.when(F.col("label") == "block", 1).otherwise(0).alias("b"), "label"))
        found = (
            open_.select("items", F.explode("items").alias("token"))
            .join(index, "token")
            .groupBy("items", "rule_id", "label", "confidence", "need").agg(F.count("*").alias("met"))
            .where("met = need")
            .groupBy("items").agg(best.alias("best"))
            .select("items", F.col("best.label").alias("label"), F.col("best.confidence").alias("sure"))
        )
    # Urls that a listed rule fits need no mined one: a host with most of them is not shuffled by its tokens.
    wanted = F.col("listed").isNull() & (F.col("host") != "")
    rest = urls.where(~wanted).select("*", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("sure"))
    return urls.where(wanted).join(found, "items", "left").unionByName(rest).select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", "label", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("label").isNotNull(), "mined").otherwise("default").alias("decided_by"),
        F.when(F.col("rule").isNull(), F.col("sure")).alias("confidence"),
    )
