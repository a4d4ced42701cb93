"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens from labelled URLs. Rules
"these tokens, so block" stay if they reach a least confidence and support,
less those of which a subset stays too. They are matched by an inverted index:
each rule is filed under its rarest token; a URL looks up its own tokens and
compares only the rules found there. Listed rules of hosts and paths come
first.

What is mined is bounded, what is matched is not: rules come from at most about
MOST_LABELLED labelled URLs (those of the lowest hashes), of each of which the
MINED_WIDTH tokens that tell most about the label are mined together, and have
at most RULE_TOKENS tokens. A URL's own tokens are all looked up: every host
label, path part, query key, the site and the ending.

Rows: a null URL and one without :// have empty host and path, no tokens and no
rule, and are allowed. Repeated URLs are judged each. Null and contradicting
labels: a null one counts as no label, of several each counts. Without labels
nothing is mined. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, stored, table

# The listed rules (verdict, host, path).
LISTED = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

SUPPORT = 0.002
LEAST_ROWS = 10
CONFIDENCE = 0.8
MOST_LABELLED = 200_000
MINED_WIDTH = 12
RULE_TOKENS = 3
BLOCK_LABEL = "label:block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, "\\A([^?#]*)", 1)
    host = F.regexp_extract(before, "\\A([^/]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def listed_rule(host: Column, path: Column, listed=LISTED) -> Column:
    """The longest listed rule that fits, as (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(listed, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its host's labels and last two labels, path
    parts by place (numbers as 0), query keys and the last part's ending."""
    host, path = host_and_path(url)
    kind = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.reverse(F.filter(F.split(host, "\\."), lambda x: x != ""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.when(F.instr(url, "://") > 0, url).otherwise(F.lit("")), "\\A[^?#]*\\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "\\A([^=]*)", 1)), lambda x: x != "")
    ending = F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})\\z", 1)
    one = lambda name, value, there: F.when(there, F.array(F.concat(F.lit(name), value))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x, i: F.concat(F.when(i == 0, F.lit("tld:")).otherwise(F.lit("host:")), x)),
            one("site:", F.concat_ws(".", F.get(labels, F.lit(1)), F.get(labels, F.lit(0))), F.size(labels) > 1),
            F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), kind(x))),
            F.transform(keys, lambda x: F.concat(F.lit("query:"), kind(x))),
            one("end:", F.lower(ending), ending != ""),
        )
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """Rules (tokens, confidence) that block, from rows (url, block)."""
    from pyspark.ml.fpm import FPGrowth

    known = labelled.where("url is not null and block is not null").select(F.col("url").cast("string").alias("url"), F.col("block").cast("boolean").alias("block"))
    total = known.count()
    if not total:
        return []
    near = F.shiftrightunsigned(F.xxhash64("url", F.lit(11)), 11) / float(1 << 53)
    rows = stored(known.where(near <= MOST_LABELLED / total).select(tokens(F.col("url")).alias("tokens"), "block").withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    n, bad = rows.agg(F.count("*"), F.sum(F.col("block").cast("long"))).first()
    if not n or not bad or bad == n:
        return []
    least = max(support, LEAST_ROWS / n)
    if least > 1:
        return []
    each = rows.select("row", "block", F.explode("tokens").alias("token"))
    share = F.sum(F.col("block").cast("long")) / F.count("*")
    tells = each.groupBy("token").agg(F.count("*").alias("n"), F.abs(share - bad / n).alias("d")).where(F.col("n") >= least * n)
    tells = tells.select("token", (F.col("d") * F.sqrt("n")).alias("told"))
    few = each.join(tells, "token").groupBy("row", "block").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("told")).alias("o"), "token"))), 1, MINED_WIDTH).alias("t"))
    names = F.transform("t", lambda x: x["token"])
    items = few.select(F.when(F.col("block"), F.concat(names, F.array(F.lit(BLOCK_LABEL)))).otherwise(names).alias("items"))
    # rows without a frequent token still count among all
    none = rows.select("row", "block").join(few.select("row"), "row", "left_anti").select(F.when(F.col("block"), F.array(F.lit(BLOCK_LABEL))).otherwise(F.array().cast("array<string>")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items.unionAll(none))
    found = model.associationRules.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BLOCK_LABEL) & (F.size("antecedent") <= RULE_TOKENS))
    # support and width bound the rules, whatever the input: each labelled URL stands for at most C(12, 3) of them
    kept: dict[tuple[str, ...], float] = {}
    for r in sorted(found.select("antecedent", "confidence").collect(), key=lambda r: (len(r[0]), sorted(r[0]))):
        rule = tuple(sorted(r[0]))
        if not any(part in kept for part in _parts(rule)):
            kept[rule] = r[1]
    return list(kept.items())


def _parts(rule: tuple[str, ...]) -> list[tuple[str, ...]]:
    """All smaller combinations of a rule's tokens."""
    from itertools import combinations

    return [part for k in range(1, len(rule)) for part in combinations(rule, k)]


def matches(found: Column, rules: list[tuple[tuple[str, ...], float]]) -> Column:
    """Whether a rule's tokens are all among ``found``, by the inverted index:
    buckets of rules by a hash of their rarest token."""
    if not rules:
        return F.lit(False)
    often: dict[str, int] = {}
    for r, _ in rules:
        for t in r:
            often[t] = often.get(t, 0) + 1
    n = len(rules)
    buckets: list[list[tuple[str, ...]]] = [[] for _ in range(n)]
    for r, _ in rules:
        buckets[zlib.crc32(min(r, key=lambda t: (often[t], t)).encode()) % n].append(r)
    rule = lambda r: F.array(*(F.lit(y) for y in r))
    none = F.array().cast("array<array<string>>")
    index = F.array(*(F.array(*map(rule, rs)) if rs else none for rs in buckets))
    held = lambda t: F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int"))
    return F.exists(found, lambda t: F.exists(held(t), lambda r: F.size(F.array_except(r, found)) == 0))


def listed_labels(pages: DataFrame, listed=LISTED) -> DataFrame:
    """url, block of the URLs that a listed rule decides."""
    url = pages["url"].cast("string")
    verdict = listed_rule(*host_and_path(url), listed)["verdict"]
    return pages.select(url.alias("url"), (verdict == "block").alias("block")).where("block is not null")


def document_labels(pages: DataFrame, labels: DataFrame, listed=LISTED) -> DataFrame:
    """url, block of the other URLs whose document is labelled: the last number
    of the path is its doc_id, and quality 0 or toxic 1 makes it bad."""
    url = pages["url"].cast("string")
    host, path = host_and_path(url)
    number = F.regexp_extract(path, "([0-9]{1,18})[^0-9]*\\z", 1).try_cast("long")
    rows = pages.where(listed_rule(host, path, listed).isNull()).select(url.alias("url"), number.alias("number"))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")) == 1
    own = labels.select(long_id(labels).alias("l_id"), bad.alias("block")).where("block is not null")
    return rows.join(own, F.col("number") == F.col("l_id")).select("url", "block")


def filter_urls(pages: DataFrame, listed=LISTED, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for each row; mined tells
    whether a mined rule would block it.

    ``labelled`` (url, block) is what rules are mined from, by default the URLs
    that the listed rules decide."""
    rules = mine(listed_labels(pages, listed) if labelled is None else labelled)
    url = pages["url"].cast("string")
    host, path = host_and_path(url)
    rows = pages.select(long_id(pages, "page_id").alias("page_id"), host.alias("host"), path.alias("path"), tokens(F.coalesce(url, F.lit(""))).alias("t"))
    rows = rows.select("*", listed_rule(F.col("host"), F.col("path"), listed).alias("r"), matches(F.col("t"), rules).alias("mined"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "mined")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled=listed_labels(pages).unionAll(document_labels(pages, table(spark, sf_dir, "labels"))))
