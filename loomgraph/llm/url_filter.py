"""URL rules, then a character language-model ratio; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Longest context in characters; contexts of 0 to ORDER characters are interpolated.
ORDER = 3
#: Windows broadcast at most: those with a HOT-th of all occurrences.
HOT = 1024
#: Weight of the next shorter context against the counts.
STRENGTH = 2.0
#: Characters assumed where nothing is known.
ALPHABET = 64.0


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(found, pattern, 1), upper, upper.lower()), F.regexp_extract(found, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. Rules are a parameter: they become one CASE."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def _framed(url: Column) -> Column:
    """The characters the models read: lower case, with a margin of contexts before the first and an end after the last."""
    return F.concat(F.lit("\u0002" * ORDER), F.lower(F.coalesce(url, F.lit(""))), F.lit("\u0003"))


def _windows(text: Column) -> Column:
    """Each character of a framed text with the ORDER characters before it."""
    return F.transform(F.sequence(F.lit(ORDER + 1), F.char_length(text)), lambda i: F.substring(text, i - F.lit(ORDER), F.lit(ORDER + 1)))


def window_counts(urls: DataFrame) -> DataFrame:
    """window, n, a, r: how often each window occurs in `text`, and how often in allowed and in blocked urls (`given`); `n` rows have a url.

    One partial aggregation; rows are the distinct windows, so the table grows with the input.
    """
    n, given = F.col("n"), F.col("given")
    return (
        urls.select(n, F.when(given == "allow", n).otherwise(0).alias("a"), F.when(given == "block", n).otherwise(0).alias("r"), F.explode(_windows(F.col("text"))).alias("window"))
        .groupBy("window")
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    )


def window_scores(windows: DataFrame) -> DataFrame:
    """windows with ln p(character | accepted) - ln p(character | rejected) of its last character, thrice: plain, and for a url counted as allowed and as blocked.

    p is interpolated from the empty context up: (count + STRENGTH * shorter) / (context count + STRENGTH). The
    counts of shorter grams and of contexts are exact sums over the windows that end with or hold them. A url
    that was counted is taken out again, once for each of its grams and contexts.
    """
    total = windows.agg(F.sum("a"), F.sum("r")).first()  # the empty context
    rows = windows
    for k in range(ORDER + 1):
        rows = rows.withColumn(f"g{k}", F.substring("window", ORDER + 1 - k, k + 1)).withColumn(f"c{k}", F.substring("window", ORDER + 1 - k, k))
    keys = [key for k in range(ORDER + 1) for key in (f"g{k}", f"c{k}") if key not in ("c0", f"g{ORDER}")]
    for key in keys:
        sums = rows.groupBy(key).agg(F.sum("a").alias(f"a_{key}"), F.sum("r").alias(f"r_{key}"))
        rows = rows.join(sums, key)

    def count(side: str, key: str) -> Column:
        if key == "c0":
            return F.lit(total[side == "r"] or 0)
        return F.col(side) if key == f"g{ORDER}" else F.col(f"{side}_{key}")

    def p(side: str, less: int) -> Column:
        out = F.lit(1 / ALPHABET)
        for k in range(ORDER + 1):
            gram, context = (F.greatest(count(side, f"{of}{k}") - F.lit(less), F.lit(0)) for of in "gc")
            out = (gram + F.lit(STRENGTH) * out) / (context + F.lit(STRENGTH))
        return out

    ratio = lambda a, r: F.log(p("a", a) / p("r", r))
    return rows.select("window", "n", ratio(0, 0).alias("plain"), ratio(1, 0).alias("allow"), ratio(0, 1).alias("block"))


def url_scores(urls: DataFrame, windows: DataFrame) -> DataFrame:
    """_key, score: the mean over its characters of each url's log ratios.

    A window with at least one HOT-th of all occurrences (so HOT of them at most) is broadcast, and those
    occurrences are summed where the url is; the others meet their window by a join on it, which has no hot key.
    """
    least = (windows.agg(F.sum("n")).first()[0] or 0) / HOT
    value = F.coalesce(F.when(F.col("given") == "allow", F.col("allow")).when(F.col("given") == "block", F.col("block")), F.col("plain"))
    parts = urls.select("_key", "given", F.explode(_windows(F.col("text"))).alias("window")).groupBy("_key", "given", "window").agg(F.count(F.lit(1)).alias("times"))
    hot = F.broadcast(windows.filter(F.col("n") >= least))
    told = parts.join(hot, "window").groupBy("_key").agg(F.sum(value * F.col("times")).alias("s"), F.sum("times").alias("k"))
    rest = parts.join(hot, "window", "left_anti").join(windows.filter(F.col("n") < least), "window").groupBy("_key").agg(F.sum(value * F.col("times")).alias("s"), F.sum("times").alias("k"))
    return told.unionByName(rest).groupBy("_key").agg((F.sum("s") / F.sum("k")).alias("score"))


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score and probability.

    Urls that a rule judges are the examples: one model of the allowed, one of the blocked, counted over all of
    them. Their scores (each with itself taken out of the counts) calibrate the mean log-likelihood difference:
    two normal distributions with one variance and equal weights give the probability that a url is to be
    allowed. A url without a rule is allowed from one half on.

    Plan: distinct urls, their windows' exact counts and their scores are tables that grow with the input, each
    written once. Equal urls are one row, so a hot url is no hot task. Only two totals and four calibrating
    numbers come to the driver.

    Defined cases: null, empty and other urls without :// have an empty host and path, no rule, and the
    models' verdict on what text there is; without examples of either class, or with equal means, every
    url without a rule is allowed (probability 0.5); ids may be null or repeat.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    named = pages.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", "n", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # the key is written with the url, so it is the same at every later read
    judged = checkpoint(named.select(F.monotonically_increasing_id().alias("_key"), "*", rule.alias("rule"), verdict.alias("given")))
    urls = judged.select("_key", "n", "given", _framed(F.col("url")).alias("text"))
    scored = checkpoint(url_scores(urls, checkpoint(window_scores(checkpoint(window_counts(urls))))))
    rows = judged.join(scored, "_key")
    n, s, allow, block = F.col("n"), F.col("score"), F.col("given") == "allow", F.col("given") == "block"
    moments = [F.sum(F.when(side, n * x)) for side in (allow, block) for x in (F.lit(1.0), s, s * s)]
    n1, s1, q1, n0, s0, q0 = rows.agg(*moments).first()
    high, low = (s1 / n1 if n1 else None), (s0 / n0 if n0 else None)
    if high is None or low is None or abs(high - low) < 1e-12:
        odds = F.lit(0.0)
    else:
        spread = max(q1 / n1 - high * high, 0.0) + max(q0 / n0 - low * low, 0.0)
        odds = F.lit((high - low) / max(spread / 2, 1e-6)) * (s - F.lit((high + low) / 2))
    probability = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-40.0)), F.lit(40.0))))
    verdicts = rows.select(F.col("url").alias("_url"), "host", "path", "rule", "given", "score", probability.alias("probability"))
    return pages.join(verdicts, F.col("url") == F.col("_url")).select(
        id_col, "host", "path", "rule", F.coalesce("given", F.when(F.col("probability") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score", "probability"
    )
