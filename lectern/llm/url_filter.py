"""URL filters: host and path rules, and for the URLs that no rule fits a ratio
of two character language models. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Guard, ascii_lower, attach, checkpointed, quoted

OUT = ("host", "path", "rule", "verdict", "lm_score")
#: Characters of context that the longest model looks back.
ORDER = 3
#: Labelled URLs whose MD5 begins with one of these digits, one in eight, are
#: kept from the counts, to calibrate on.
HELD_OUT = ("0", "1")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, path up to ? or #; both empty
    without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^(?s).*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (verdict, host/path), and its verdict; else
    null. A rule fits its host and all subdomains if the path starts alike."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _model(grams: DataFrame) -> DataFrame:
    """gram, n and llr: the log of accepted over rejected probability of the
    gram's last character after those before it, under interpolated
    Witten-Bell smoothing of orders 0 to ORDER."""
    below, floor = None, 1.0 / 256
    for order in range(ORDER + 1):
        g = grams.withColumn("g", F.substr("gram", F.lit(ORDER + 1 - order))).groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n"))
        context = Window.partitionBy(F.substr("g", F.lit(1), F.lit(order)) if order else F.lit(""))
        cols = {}
        for c in "ar":
            cols["t" + c], cols["d" + c] = F.sum(c).over(context), F.sum((F.col(c) > 0).cast("double")).over(context)
        g = g.withColumns(cols)
        if below is not None:
            g = g.withColumn("low", F.substr("g", F.lit(2))).join(below, "low")
        p = {}
        for c in "ar":
            lower = F.col("p" + c) if below is not None else F.lit(floor)
            seen = F.col("t" + c) + F.col("d" + c)
            p["q" + c] = F.when(seen > 0, (F.col(c) + F.col("d" + c) * lower) / seen).otherwise(lower)
        g = g.withColumns(p)
        below = g.select(F.col("g").alias("low"), F.col("qa").alias("pa"), F.col("qr").alias("pr"), "n")
        if order < ORDER:
            below = below.drop("n")
    return below.select(F.col("low").alias("gram"), "n", (F.log("pa") - F.log("pr")).alias("llr"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """pages plus host, path, rule (null where none fits), verdict (allow or
    block) and lm_score (length-normalised log-likelihood ratio less the
    calibrated threshold; null where a rule decides).

    The models see host and path only, as the rules do: scheme, query string and
    fragment are not scored, so URLs that differ in these alone are judged alike.
    They count every URL that a rule allows or blocks, but for one in
    eight by hash, which set the threshold: between the mean scores of both
    classes, nearer the class that varies less. Scores are per distinct string;
    a n-gram or URL that a third of the rows share is looked up by attach().
    Beside each character stands its string's digest, not the string, so work
    grows with the length of a URL, not its square.

    Defined results: a null url, or one without ://, has empty host and path and
    is scored as such; URLs of any length are scored whole; if one class has no
    URL, all scores are 0 and undecided URLs are allowed; an empty table gives an
    empty table; an input column named like an output is replaced; repeated rows
    are judged alike.
    """
    host, path = host_and_path(quoted(url_col))
    safe = Guard(pages, OUT, host=host, path=path, i=F.monotonically_increasing_id())
    rows = safe.rows.withColumnsRenamed({"__host": "host", "__path": "path"})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "__v": verdict, "__u": F.unhex(F.md5(F.concat("host", "path")))})
    held = F.substring(F.hex("__u"), 1, 1).isin(*HELD_OUT)
    counted = lambda what: F.when((F.col("__v") == what) & ~held, F.col("m")).otherwise(0)
    urls = rows.groupBy("__u", "__v").agg(F.first(F.concat("host", "path")).alias("text"), F.count(F.lit(1)).alias("m")).withColumns({"a": counted("allow"), "r": counted("block")})
    # dealt by number, so that a small table's characters keep all cores busy too
    spark = pages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    urls = checkpointed(urls.repartition(parts, "__u"))
    chars = F.regexp_extract_all(F.concat(F.lit("\u0002" * ORDER), "text", F.lit("\u0003")), F.lit("(?s)."), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.size("c") - ORDER), lambda i: F.array_join(F.slice("c", i, F.lit(ORDER + 1)), ""))
    spots = urls.withColumn("c", chars).select("__u", "__v", "m", "a", "r", F.explode(grams).alias("gram"))
    model = checkpointed(_model(spots.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))))
    scored = attach(spots.select("__u", "__v", "m", "gram"), model, ["gram"], ["llr"], "n", ["__u"])
    scored = checkpointed(scored.groupBy("__u", "__v", "m").agg(F.avg("llr").alias("score")))
    both = {r["__v"]: r for r in scored.where(held & F.col("__v").isNotNull()).groupBy("__v").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).collect()}
    line = 0.0
    if len(both) == 2:
        a, r = both["allow"], both["block"]
        spread = a["sd"] + r["sd"]
        line = (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / spread if spread else (a["mean"] + r["mean"]) / 2
    open_ones = scored.where(F.col("__v").isNull()).select("__u", "m", (F.col("score") - line).alias("lm_score"))
    out = attach(rows, open_ones, ["__u"], ["lm_score"], "m", ["__i"])
    out = out.withColumn("lm_score", F.when(F.col("__v").isNull(), F.col("lm_score")))
    return safe.back(out.withColumn("verdict", F.coalesce("__v", F.when(F.col("lm_score") >= 0, "allow").otherwise("block"))))
