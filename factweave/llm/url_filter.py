"""URL filters: stated rules, and for other URLs gradient-boosted trees on lexical features.

The trees learn from URLs that are labelled; the rules label those that they fit.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FEATURES = [
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "other_ratio",
    "hyphens", "entropy", "host_entropy", "parameters", "secure", "suffix_share", "suffix_blocked",
]

#: Labelled rows are dealt by a hash of the URL; a row learns from its suffix's statistics in the other folds.
FOLDS = 5
#: Rows of the overall blocked share that every suffix's own share is mixed with.
PRIOR_ROWS = 10.0


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """The struct (rule, action) of the longest rule that fits, else null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fits)


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    size = F.length(text)

    def part(c: Column) -> Column:
        share = (size - F.length(F.replace(text, c))) / size
        return -share * F.log2(share)

    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a + part(c))).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def label_sample(known: DataFrame, totals: dict[float, int], sample: int) -> DataFrame:
    """About ``sample`` rows of known, chosen by a hash of URL and row id, each label's apart.

    A label has an equal part of the sample, or all its rows if they are fewer;
    what it leaves goes to the others.
    """
    left, share = sample, {}
    for i, (label, n) in enumerate(sorted(totals.items(), key=lambda x: x[1])):
        part = min(n, max(1, left // (len(totals) - i)))
        share[label] = part / n
        left -= part
    if not share:
        return known.limit(0)
    limits = F.create_map(*[F.lit(float(x)) for kv in share.items() for x in kv])
    return known.filter(F.pmod(F.xxhash64("url", "id"), F.lit(1 << 40)) < F.element_at(limits, F.col("label")) * (1 << 40))


def features(parts: DataFrame) -> DataFrame:
    """parts has url, host and path; adds the lexical features but those of the suffix, and the suffix itself."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return parts.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "labels": count(host, r"\.") + 1,
            "depth": count(F.regexp_replace(path, "/$", ""), "/"),
            "digit_ratio": count(url, "[0-9]") / size,
            "other_ratio": count(url, "[^0-9A-Za-z]") / size,
            "hyphens": count(host, "-"),
            "entropy": entropy(url),
            "host_entropy": entropy(host),
            "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
            "secure": F.startswith(url, F.lit("https:")).cast("int"),
            "suffix": suffix_of(host),
        }
    )


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS))


def suffix_counts(known: DataFrame) -> DataFrame:
    """suffix, fold, rows, blocked of all labelled rows: sums with a map side, five rows for each suffix at most."""
    own = known.groupBy(suffix_of(F.col("host")).alias("suffix"), fold_of(F.col("url")).alias("fold"))
    return own.agg(F.count("*").alias("rows"), F.sum("label").alias("blocked"))


def with_suffix_statistics(rows: DataFrame, counts: DataFrame, out_of_fold: bool) -> DataFrame:
    """Adds suffix_share, of all labelled rows, and suffix_blocked, the suffix's blocked share mixed with the overall one.

    out_of_fold: what is counted leaves out the fold of the row's own URL, so
    that no row's label is among its features. An unknown suffix has share 0
    and the overall blocked share; without labelled rows that is 0.5.
    """
    total = counts.agg(F.sum("rows").alias("all_rows"), F.sum("blocked").alias("all_blocked"))
    by_suffix = counts.groupBy("suffix").agg(F.sum("rows").alias("s_rows"), F.sum("blocked").alias("s_blocked"))
    both = rows.join(by_suffix, "suffix", "left").crossJoin(F.broadcast(total))
    parts = ["s_rows", "s_blocked", "all_rows", "all_blocked"]
    value = {c: F.coalesce(c, F.lit(0.0)) for c in parts}
    if out_of_fold:
        own = counts.select("suffix", "fold", F.col("rows").alias("o_rows"), F.col("blocked").alias("o_blocked"))
        fold = counts.groupBy("fold").agg(F.sum("rows").alias("f_rows"), F.sum("blocked").alias("f_blocked"))
        both = both.withColumn("fold", fold_of(F.col("url"))).join(own, ["suffix", "fold"], "left").join(F.broadcast(fold), "fold", "left")
        value = {c: value[c] - F.coalesce(o, F.lit(0.0)) for c, o in zip(parts, ("o_rows", "o_blocked", "f_rows", "f_blocked"))}
    overall = F.when(value["all_rows"] > 0, value["all_blocked"] / value["all_rows"]).otherwise(0.5)
    share = F.when(value["all_rows"] > 0, value["s_rows"] / value["all_rows"]).otherwise(0.0)
    mixed = (value["s_blocked"] + PRIOR_ROWS * overall) / (value["s_rows"] + PRIOR_ROWS)
    return both.withColumn("suffix_share", share).withColumn("suffix_blocked", mixed)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    labelled: DataFrame | None = None,
    sample: int = 20_000,
    trees: int = 20,
    depth: int = 4,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    verdict is the action of the longest rule that fits, else that of the
    trees. labelled: url and label (1 to block); by default the rows that a rule
    fits, with its action. The trees learn from about ``sample`` of the labelled
    rows, an equal part of each label as far as it has rows, and either kind of
    label weighs half of all. Statistics of suffixes (the host's last label)
    come from all labelled rows; see with_suffix_statistics. With one kind of
    label only, that kind is the verdict; with no labels, allow. A null URL and
    one without :// have an empty host and path and are judged by the trees,
    whole URLs of any length. Repeated rows get equal answers; columns other
    than the two are not read; an empty table gives no rows.
    """
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = parts.filter("found is not null").select(
            F.col("page_id").alias("id"), "url", "host", "path", (F.col("found.action") == "block").cast("double").alias("label")
        )
    else:
        known = labelled.filter("url is not null and label is not null").select(
            F.col(id_col).alias("id") if id_col in labelled.columns else F.monotonically_increasing_id().alias("id"),
            "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")
        )
    counts = materialize(suffix_counts(known), "url-suffixes")
    seen = counts.agg(F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked")).first()
    n, blocked = seen["rows"] or 0, int(seen["blocked"] or 0)
    totals = {label: k for label, k in ((0.0, n - blocked), (1.0, blocked)) if k}

    def assembled(df: DataFrame, out_of_fold: bool) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix_statistics(features(df), counts, out_of_fold))

    if len(totals) == 2:
        train = materialize(label_sample(known, totals, sample), "labelled-urls")
        overall = train.agg(F.avg("label")).first()[0]
        learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, checkpointInterval=-1, weightCol="weight", minWeightFractionPerNode=0.02)
        balance = F.when(F.col("label") > 0, 0.5 / overall).otherwise(0.5 / (1 - overall))
        model = learner.fit(assembled(train, True).select("features", "label", balance.alias("weight")))
        judged = model.transform(assembled(parts, False))
        judged = judged.withColumn("block_score", vector_to_array("probability")[1])
    else:
        judged = parts.withColumn("block_score", F.lit(max(totals, default=0.0)))
    said = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", said).alias("verdict"), "block_score"
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
