"""Skills in long form (record_id, uri, ...): matching, weights, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tier weights by reuse level and the domain keywords.
TIERS = {"transversal": 0.3, "cross-sector": 0.5, "sector-specific": 0.8, "occupation-specific": 1.0}
WEIGHTS = {"ner": 1.0, "pos": 1.0, "dictionary": 20.0, "embedding": 2.0}
RELEVANT = 0.35


#: Rows of words or labels that go to all tasks at most; more are joined by key.
MOST_BROADCAST = 2_000_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with a hint to send it to all tasks if it is small enough; it is
    counted, so it should be kept."""
    return F.broadcast(df) if df.count() <= most else df


def uniform_weights(skills: DataFrame) -> DataFrame:
    """1.0 explicit, 0.5 implicit, the larger of a record's repeats."""
    w = F.when(F.col("explicit"), 1.0).otherwise(0.5)
    return skills.where(F.trim("uri") != "").groupBy("record_id", "uri").agg(F.max(w).alias("w"))


def corpus_idf(skills: DataFrame, records: DataFrame) -> DataFrame:
    """uri, df, idf = ln(1 + N / df); N counts records without skills."""
    n = records.agg(F.count("*").alias("n"))
    df = skills.groupBy("uri").agg(F.countDistinct("record_id").alias("df"))
    return df.join(F.broadcast(n)).select("uri", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def median_idf(idf: DataFrame) -> DataFrame:
    return idf.agg(F.coalesce(F.median("idf"), F.lit(0.0)).alias("median_idf"))


def tier_weight(level: Column) -> Column:
    out = F.lit(0.5)
    for name, w in TIERS.items():
        out = F.when(F.lower(F.trim(level)) == name, w).otherwise(out)
    return out


def idf_weights(skills: DataFrame, idf: DataFrame, cap: float = 3.0, levels: DataFrame | None = None) -> DataFrame:
    """[tier] * min(idf, cap) * (1 explicit, .5 implicit), the largest of repeats;
    a skill without idf has 1."""
    rows = skills.where(F.trim("uri") != "").join(idf.select("uri", "idf"), "uri", "left").fillna(1.0, ["idf"])
    w = F.least("idf", F.lit(cap)) * F.when(F.col("explicit"), 1.0).otherwise(0.5)
    if levels is not None:
        rows = rows.join(levels.select("uri", "reuse_level"), "uri", "left")
        w = w * tier_weight(F.coalesce("reuse_level", F.lit("")))
    return rows.groupBy("record_id", "uri").agg(F.max(w).alias("w"))


def ngrams(words: Column, longest: int = 8) -> Column:
    """All runs of 1..longest words, space-joined."""
    def of(n):
        first = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - (n - 1)))
        return first if n == 1 else F.transform(first, lambda _, i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(n))))

    return F.flatten(F.array(*(of(n) for n in range(1, longest + 1))))


def dictionary_matches(records: DataFrame, labels: DataFrame, words: Column, longest: int = 8) -> DataFrame:
    """record_id, uri, hits: phrases of a record that are labels (label_lc, uri)."""
    # the words are a column of their own first: inside the n-grams' lambdas they would be found again for each place
    # only runs as long as some label are made, and they meet the labels before they are counted
    rows = records.select("record_id", words.alias("__words"))
    most = labels.agg(F.max(F.length("label_lc") - F.length(F.replace("label_lc", F.lit(" "))) + 1)).first()[0] or 1
    grams = rows.select("record_id", F.explode(ngrams(F.col("__words"), min(longest, most))).alias("label_lc"))
    return grams.join(small(labels), "label_lc").groupBy("record_id", "uri").agg(F.count("*").alias("hits"))


def relevance(ner: Column, pos: Column, dictionary: Column, embedding: Column, weights: dict | None = None) -> Column:
    """Weighted mean of the four modules' scores."""
    w = WEIGHTS | (weights or {})
    return (w["ner"] * ner + w["pos"] * pos + w["dictionary"] * dictionary + w["embedding"] * embedding) / sum(w.values())


def label_index(taxonomy: DataFrame) -> DataFrame:
    """label_lc, uri from (pos, uri, preferred_label, alt_labels); the first
    label in file order wins."""
    each = taxonomy.select("pos", "uri", F.posexplode(F.concat(F.array("preferred_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("at", "label"))
    each = each.withColumn("label_lc", F.lower("label")).where("label_lc <> ''")
    return each.groupBy("label_lc").agg(F.min_by("uri", F.struct("pos", "at")).alias("uri"))


def best_surfaces(candidates: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """record_id, uri, matched_text, confidence from candidates (record_id,
    surface, dictionary_uri, nearest_uri, relevance): those that reach the
    threshold, the dictionary's uri before the nearest one, and of each uri the
    surface of the highest relevance (of equal ones the least)."""
    rows = candidates.where(F.col("relevance") >= threshold).withColumn("uri", F.coalesce("dictionary_uri", "nearest_uri")).where("uri is not null")
    best = rows.groupBy("record_id", "uri").agg(F.min(F.struct((-F.col("relevance")).alias("o"), "surface")).alias("b"))
    return best.select("record_id", "uri", F.col("b.surface").alias("matched_text"), F.round(-F.col("b.o"), 4).alias("confidence"))


def implicit_skills(neighbours: DataFrame, skills: DataFrame, top_k: int = 10, threshold: float = 0.6) -> DataFrame:
    """record_id, uri, confidence: skills of up to top_k neighbours (record_id,
    other_id, cosine) at the threshold or above that the record lacks."""
    near = neighbours.where((F.col("cosine") >= threshold) & (F.col("record_id") != F.col("other_id")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("cosine"), "other_id"))).where(F.col("r") <= top_k)
    theirs = skills.where("explicit").select(F.col("record_id").alias("other_id"), "uri")
    found = near.join(theirs, "other_id").groupBy("record_id", "uri").agg(F.round(F.max("cosine"), 4).alias("confidence"))
    return found.join(skills.where("explicit").select("record_id", "uri"), ["record_id", "uri"], "left_anti")


def frequent_labels(skills: DataFrame, records: DataFrame, share: float = 0.7) -> DataFrame:
    """Labels in more than a share of all records."""
    n = records.agg(F.count("*").alias("n"))
    df = skills.groupBy("preferred_label").agg(F.countDistinct("record_id").alias("df"))
    return df.join(F.broadcast(n)).where(F.col("df") > share * F.col("n")).select("preferred_label", "df")


def domain_relevant(label: Column, level: Column, keywords: list[str], blocked: list[str]) -> Column:
    """Not blocked, and reusable beyond a sector or naming a keyword."""
    low = F.lower(label)
    named = F.exists(F.array(*(F.lit(k) for k in keywords)), lambda k: F.contains(low, k))
    wide = F.coalesce(F.lower(level), F.lit("")).isin("cross-sector", "transversal", "")
    return ~low.isin(blocked) & (wide | named)


def filter_skills(skills: DataFrame, records: DataFrame, levels: DataFrame, keywords: list[str], blocked: list[str], share: float = 0.7, least: float = 0.7) -> DataFrame:
    """Domain, then stop labels (computed on what the domain left, dropping
    implicit skills only), then the implicit confidence."""
    kept = skills.join(levels, "uri", "left").where(domain_relevant(F.col("preferred_label"), F.col("reuse_level"), keywords, blocked))
    stop = frequent_labels(kept, records, share).select("preferred_label", F.lit(True).alias("stop"))
    rows = kept.join(F.broadcast(stop), "preferred_label", "left")
    return rows.where(F.col("explicit") | (F.col("stop").isNull() & (F.col("confidence") >= least))).drop("stop")


def skill_columns(skills: DataFrame) -> DataFrame:
    """explicit_skills, implicit_skills, all_skills, skill_uris by record."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("uri"), F.col("preferred_label").alias("l"), F.col("explicit").alias("e"))))
    by = skills.groupBy("record_id").agg(rows.alias("s"))
    names = lambda keep: F.transform(F.filter("s", keep), lambda x: x["l"])
    return by.select("record_id", names(lambda x: x["e"]).alias("explicit_skills"), names(lambda x: ~x["e"]).alias("implicit_skills"), names(lambda x: F.lit(True)).alias("all_skills"), F.transform("s", lambda x: x["uri"]).alias("skill_uris"))
