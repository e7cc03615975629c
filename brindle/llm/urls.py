"""URL filtering: fixed host rules, then association rules mined from the labelled URLs.

A fixed rule names a host and a path prefix; it fits the host and its subdomains, and the
longest that fits decides.  Labelled URLs are those with a value (allow or block) in a label
column, if one is named, else those that fixed rules decide.  Spark's FP-growth mines the
token combinations that occur often among them; a combination becomes a rule if

* at least ``MIN_COUNT`` labelled URLs, and the share ``MIN_SUPPORT``, have it and the verdict,
* its confidence, smoothed by one URL of each verdict, reaches ``MIN_CONFIDENCE``,
* the verdict is commoner with it than without (lift above 1),
* labelled URLs are at least the share ``MIN_KNOWN`` of all URLs that have it, as a rule
  learnt from few of the URLs that it would decide only repeats how labels were given,
* and no combination of fewer of its tokens that passes all this is as sure of the verdict.

Where fixed rules gave the labels, the tokens of their hosts are no evidence and aren't mined.

A rule is listed under the token that fewest URLs have (inverted index); a URL that no fixed
rule fits looks up its tokens and takes the verdict of the surest rule that it contains.

All tokens of all URLs are mined and matched.  Tokens that the same URLs have are mined as one,
so a long URL that comes again and again doesn't make combinations of its own.

Cases: null URL and URL without ``://`` have an empty host and path, no rule and no tokens;
very long URLs are read whole; a URL that no rule knows is allowed; of equally sure rules the
longer, then the better supported, then ``block`` decides; without labelled URLs there are no
mined rules; repeated rows are judged alike; an empty table gives no rows; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared

#: Verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_COUNT = 10
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.9
MIN_KNOWN = 0.5
#: Tokens of a URL that the SQL looks at (it tries all combinations); mining has no such bound.
ITEMS = 12
#: Rules of more tokens are compared with those that they contain, not with all their parts.
ENUMERATED = 12
DEFAULT = "allow"
#: Stands before a verdict among tokens; no URL token starts so.
LABEL = "=> "

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL, empty where there are none."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, own_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(prefix)
        name = F.when(fits, own_host + prefix).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments with digits as #, query keys."""
    text = F.coalesce(url, F.lit(""))
    filled = lambda parts: F.filter(parts, lambda x: F.length(x) > 0)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    parts = [
        F.transform(filled(F.array(F.regexp_extract(text, r"\A([^:/?#]*)://", 1))), lambda x: F.concat(F.lit("s:"), F.lower(x))),
        F.transform(filled(F.split(host, r"\.")), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(filled(F.split(path, "/")), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(filled(F.split(query, "&")), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1))),
    ]
    return F.when(F.instr(text, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def named(rules=RULES) -> list[str]:
    """Tokens of the fixed rules' hosts."""
    return sorted({f"h:{part}" for _, host, _ in rules for part in host.split(".") if part})


def parsed(pages: DataFrame, rules=RULES, label: str | None = None) -> DataFrame:
    """row, page_id, host, path, rule, verdict (of the fixed rule), tokens, label; written once.

    Labels that fixed rules gave would be learnt from the hosts that these name: such tokens are
    left out, so that the rest of a URL has to tell."""
    host, path = host_and_path(F.col("url"))
    given = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), given.alias("given"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "given")
    known = F.col("verdict") if label is None else F.when(F.col("given").isin("allow", "block"), F.col("given"))
    told = F.col("tokens") if label is not None else F.array_except("tokens", F.array(*map(F.lit, named(rules))))
    rows = rows.withColumns({"label": known, "tokens": told, "row": F.monotonically_increasing_id()})
    return shared.materialize(rows.select("row", "page_id", "host", "path", "rule", "verdict", "tokens", "label"), "urls")


def alike(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """first, same: tokens that ``least`` labelled URLs have, and that the same URLs have among
    all; they can't be told apart by any URL, so the first by name stands for its class in a
    rule (two of a class in a rule say no more than one)."""
    each = lambda t: t.select("row", F.explode("tokens").alias("token"))
    counted = each(known).groupBy("token").agg(F.count("*").alias("uses")).filter(F.col("uses") >= least).select("token")
    prints = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in range(2)]
    found = each(rows).join(shared.materialize(counted, "tokens"), "token").groupBy("token").agg(F.count("*").alias("n"), *prints)
    classes = found.groupBy("n", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("same"))
    return shared.materialize(classes.select(F.col("same")[0].alias("first"), "same"), "alike")


def transactions(known: DataFrame, classes: DataFrame) -> DataFrame:
    """row, label and the tokens of each labelled URL, one of each class."""
    each = known.select("row", "label", F.explode("tokens").alias("token"))
    return each.join(classes.select(F.col("first").alias("token")), "token").groupBy("row", "label").agg(F.collect_list("token").alias("items"))


def spelt_out(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules with each token of a class in its place."""
    each = found.select("*", F.explode("rule_tokens").alias("first")).join(classes, "first")
    own = each.groupBy(*found.columns).agg(F.collect_list("same").alias("all"))
    ways = F.aggregate("all", F.array(F.array().cast("array<string>")), lambda done, same: F.flatten(F.transform(done, lambda d: F.transform(same, lambda t: F.concat(d, F.array(t))))))
    return own.withColumn("rule_tokens", F.explode(ways)).withColumn("rule_tokens", F.array_sort("rule_tokens")).select(*found.columns)


def mine(rows: DataFrame, **options) -> DataFrame:
    """Rules from rows with ``row``, ``tokens`` and ``label``: rule_tokens, verdict, hits, uses, confidence."""
    found, classes = mined(rows, **options)
    return found if classes is None else spelt_out(found, classes)


def mined(rows: DataFrame, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_known: float = MIN_KNOWN) -> tuple[DataFrame, DataFrame | None]:
    """The rules of first tokens, and the classes of tokens (None without labelled rows)."""
    spark = rows.sparkSession
    known = rows.filter("label is not null").select("row", "label", "tokens")
    n = known.count()
    schema = "rule_tokens array<string>, verdict string, hits long, uses long, confidence double"
    if not n:
        return spark.createDataFrame([], schema), None
    least = max(min_count, min_support * n)
    classes = alike(rows, known, least)
    baskets = transactions(known, classes).select(F.concat("items", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=0.0, numPartitions=shared.shuffle_partitions(spark)).fit(baskets)
    sets = shared.materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    labelled = F.exists("items", lambda x: x.startswith(LABEL))
    whole = F.filter("items", lambda x: ~x.startswith(LABEL))
    said = F.substring(F.filter("items", lambda x: x.startswith(LABEL))[0], len(LABEL) + 1, 100)
    # A basket without a rare token still counts: what FP-growth counts is the labelled URLs.
    totals = known.groupBy(F.col("label").alias("verdict")).agg((F.count("*") / n).alias("base"))
    hits = sets.filter(labelled & (F.size("items") > 1)).select(whole.alias("rule_tokens"), said.alias("verdict"), F.col("freq").alias("hits"))
    uses = sets.filter(~labelled).select(F.col("items").alias("rule_tokens"), F.col("freq").alias("uses"))
    found = hits.join(uses, "rule_tokens").join(F.broadcast(totals), "verdict").withColumn("confidence", F.round((F.col("hits") + 1) / (F.col("uses") + 2), 9))
    sure = shared.materialize(found.filter((F.col("hits") >= least) & (F.col("confidence") >= min_confidence) & (F.col("hits") / F.col("uses") > F.col("base"))).select("rule_tokens", "verdict", "hits", "uses", "confidence"), "sure")
    seen = matches(rows.select("tokens"), inverted(sure, rows)).groupBy("rule_tokens", "verdict").agg(F.count("*").alias("all_uses"))
    kept = sure.join(seen, ["rule_tokens", "verdict"]).filter(F.col("uses") >= min_known * F.col("all_uses"))
    return _without_beaten(shared.materialize(kept.select("rule_tokens", "verdict", "hits", "uses", "confidence"), "known")), classes


def _without_beaten(found: DataFrame) -> DataFrame:
    """Rules without those of which some of the tokens are as sure of the same verdict."""
    n = F.size("rule_tokens")
    some = lambda m: F.filter("rule_tokens", lambda t, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1)
    fewer = F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 2).cast("int")), some)
    larger = found.filter((n > 1) & (n <= ENUMERATED)).select("verdict", "rule_tokens", "confidence", F.explode(fewer).alias("fewer"))
    smaller = found.select("verdict", F.col("rule_tokens").alias("fewer"), F.col("confidence").alias("sure"))
    beaten = larger.join(smaller, ["verdict", "fewer"]).filter("sure >= confidence").select("verdict", "rule_tokens")
    # Of longer rules the parts are found by their first tokens.
    longer = found.filter(n > ENUMERATED).select("verdict", "rule_tokens", "confidence", F.explode("rule_tokens").alias("head"))
    inside = longer.join(smaller.withColumn("head", F.col("fewer")[0]), ["verdict", "head"]).filter((F.col("sure") >= F.col("confidence")) & (F.size("fewer") < n) & (F.size(F.array_except("fewer", "rule_tokens")) == 0))
    beaten = beaten.union(inside.select("verdict", "rule_tokens")).distinct()
    return shared.materialize(found.join(beaten, ["verdict", "rule_tokens"], "left_anti").select("rule_tokens", "verdict", "hits", "uses", "confidence"), "best")


def inverted(found: DataFrame, rows: DataFrame) -> DataFrame:
    """token and the rules of which it is the rarest token among all URLs (ties by name)."""
    posting = shared.materialize(found.select("*", F.explode("rule_tokens").alias("token")), "postings")
    urls = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("common"))
    common = urls.join(posting.select("token").distinct(), "token")
    rarest = posting.join(common, "token").groupBy("rule_tokens", "verdict", "hits", "confidence").agg(F.min(F.struct("common", "token"))["token"].alias("token"))
    listed = rarest.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("confidence", "hits", "verdict", "rule_tokens"))).alias("listed"))
    return shared.materialize(listed, "index")


def matches(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (with ``tokens``) beside each rule of the index that they contain."""
    each = rows.withColumn("token", F.explode("tokens")).join(index, "token")
    listed = each.withColumn("rule", F.explode("listed")).filter(F.size(F.array_except("rule.rule_tokens", "tokens")) == 0)
    return listed.select(*rows.columns, "rule.*")


def mined_verdicts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """row and verdict of the surest rule, for each row (row, tokens) that contains one."""
    best = F.max(F.struct("confidence", F.size("rule_tokens").alias("size"), "hits", "verdict"))
    return matches(rows.select("row", "tokens"), inverted(found, rows)).groupBy("row").agg(best["verdict"].alias("mined"))


def judge(pages: DataFrame, rules=RULES, label: str | None = None, **options) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and mined (whether an
    association rule decided)."""
    rows = parsed(pages, rules, label)
    said = mined_verdicts(rows.filter("verdict is null"), mined(rows, **options)[0])
    joined = rows.select("row", "page_id", "host", "path", "rule", "verdict").join(said, "row", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(DEFAULT)).alias("verdict"), F.col("mined").isNotNull().alias("mined"))
