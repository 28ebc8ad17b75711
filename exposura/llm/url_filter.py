"""URL filter by a ratio of two character language models, in DataFrame operations only.

Fixed rules decide the URLs they fit; they also label what the models learn from: one model of the accepted and
one of the rejected URLs. Each is a Markov model of variable order: the probability of a character is interpolated
from the longest context seen down to none, by Witten-Bell weights (the more different characters followed a
context, the more the next shorter one counts). A URL's score is the difference of the two log-likelihoods per
character; the threshold is calibrated on labelled URLs held out from the models, where both classes are equally
many of their standard deviations away. Learning reads all labelled rows, once for each distinct URL and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposura.session import materialize

# The verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
HELD_OUT = 5  # one of so many labelled URLs calibrates
HOT_GRAMS = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _STOP = "\u0002", "\u0003"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruled``, the verdict of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return urls.withColumns({"rule": rule, "ruled": ruled})


def _grams(texts: DataFrame, *kept: str) -> DataFrame:
    """One row for each character and the end of ``text``: the character behind its ``ORDER`` characters of context."""
    letters = F.split(F.concat(F.lit(_START * ORDER), F.col("text"), F.lit(_STOP)), "")
    with_letters = texts.select(*kept, letters.alias("letters"))
    gram = F.transform(
        F.sequence(F.lit(0), F.size("letters") - (ORDER + 1)),
        lambda i: F.concat(*[F.get("letters", i + k) for k in range(ORDER + 1)]),
    )
    return with_letters.select(*kept, F.explode(gram).alias("gram"))


def _log_ratios(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, ratio``: natural log of the two models' probabilities for the last character of each gram.

    ``counts``: gram, a, b (times seen in accepted and rejected URLs).
    """
    def suffixes(df, *kept):
        orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
        return df.select("gram", *kept, orders).withColumn("end", F.expr("right(gram, k + 1)"))

    ends = materialize(suffixes(counts, "a", "b").groupBy("k", "end").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    contexts = ends.withColumn("context", F.expr("left(end, k)")).groupBy("k", "context").agg(
        F.sum("a").alias("all_a"), F.sum("b").alias("all_b"),
        F.sum(F.when(F.col("a") > 0, 1).otherwise(0)).alias("kinds_a"), F.sum(F.when(F.col("b") > 0, 1).otherwise(0)).alias("kinds_b"),
    )
    contexts = materialize(contexts)
    none = contexts.where("k = 0").first()
    wanted = suffixes(grams).withColumn("context", F.expr("left(end, k)")).join(ends, ["k", "end"], "left")
    # all grams share the empty context, so that it is a constant and no join key
    longer = wanted.where("k > 0").join(contexts.where("k > 0"), ["k", "context"], "left")
    shortest = wanted.where("k = 0").withColumns({
        c: F.lit(none[c] if none else 0).cast("long") for c in ("all_a", "all_b", "kinds_a", "kinds_b")
    })
    measures = ["a", "b", "all_a", "all_b", "kinds_a", "kinds_b"]
    steps = longer.unionByName(shortest).select("gram", F.struct("k", *[
        F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in measures
    ]).alias("step")).groupBy("gram").agg(F.sort_array(F.collect_list("step")).alias("steps"))  # ORDER + 1 of them

    def refine(so_far, step, which):
        total = step[f"all_{which}"] + step[f"kinds_{which}"]
        return F.when(total > 0, (step[which] + step[f"kinds_{which}"] * so_far) / total).otherwise(so_far)

    def probability(which):
        return F.aggregate("steps", F.lit(1 / 256), lambda p, step: refine(p, step, which))

    return steps.select("gram", (F.log(probability("a")) - F.log(probability("b"))).alias("ratio"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict, score, threshold``.

    ``verdict`` is the rule's where one fits. Otherwise it is ``allow`` where the URL's score reaches the threshold;
    ``score`` is null for URLs that a rule decides. The models read whole URLs, query and fragment included. A null URL has
    an empty host and path and is scored as an empty text; one without ``://`` has an empty host and path only. With no labelled URLs of one kind every score is compared with zero, and without
    any at all every score is zero. Equal URLs get equal scores; repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    text = F.coalesce("url", F.lit(""))
    parts = with_rule(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    keyed = parts.withColumns({"key_a": F.xxhash64(text), "key_b": F.xxhash64(F.lit("b"), text)})
    keys = ["key_a", "key_b"]
    distinct = materialize(keyed.select(*keys, "ruled", text.alias("text")).distinct())
    trains = F.pmod("key_b", F.lit(HELD_OUT)) != 0
    counts = _grams(distinct.where(F.col("ruled").isNotNull() & trains), "ruled").groupBy("gram").agg(
        F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"),
    )
    scored_grams = materialize(
        _grams(distinct.where(F.col("ruled").isNull() | ~trains), *keys, "ruled")
        .groupBy(*keys, "ruled", "gram").agg(F.count(F.lit(1)).alias("times"))
    )
    seen = materialize(scored_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("urls")))
    ratios = materialize(_log_ratios(materialize(counts), seen.select("gram")).join(seen, "gram"))
    # a gram of very many URLs is no join key; of those above one in HOT_GRAMS of all rows there are fewer than HOT_GRAMS
    bound = scored_grams.count() // HOT_GRAMS
    hot = F.broadcast(ratios.where(F.col("urls") > bound).select("gram", "ratio"))
    rare = scored_grams.join(hot.select("gram"), "gram", "left_anti").join(ratios.where(F.col("urls") <= bound).select("gram", "ratio"), "gram")
    scores = materialize(
        scored_grams.join(hot, "gram").unionByName(rare).groupBy(*keys, "ruled")
        .agg((F.sum(F.col("times") * F.col("ratio")) / F.sum("times")).alias("score"))
    )
    rows = {r["ruled"]: r for r in scores.where("ruled is not null").groupBy("ruled").agg(
        F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread")
    ).collect()}  # two rows
    threshold = 0.0
    if len(rows) == 2:
        allow, block = rows["allow"], rows["block"]
        total = allow["spread"] + block["spread"]
        share = block["spread"] / total if total else 0.5
        threshold = block["mean"] + (allow["mean"] - block["mean"]) * share
    out = keyed.join(scores.where("ruled is null").select(*keys, "score"), keys, "left")
    score = F.when(F.col("ruled").isNull(), F.col("score"))
    verdict = F.coalesce("ruled", F.when(score >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"), F.lit(threshold).alias("threshold"))
