"""Finding patterns in text: matches with offsets, summaries, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.patterns import Pattern

#: Samples and values that a summary reports of each type.
SAMPLES, VALUES = 4, 100
#: Texts with fewer characters other than white space are scans.
SCANNED = 24


def matches(df: DataFrame, patterns: list[Pattern], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, type, match_idx, value, start_off, end_off (code points, end exclusive): leftmost, non-overlapping, in order.

    Each pattern stays a literal in one projection, so it is compiled once and the text is read once; where a pattern
    has a hint, only texts that the hint finds are read for it. Empty matches are dropped. Offsets add up what stands
    between the matches, which is cut out of texts with matches only. A pattern of certain pages matches on those only,
    if the keys have a page.
    """
    t, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")

    def hits(p: Pattern) -> Column:
        m = F.regexp_extract_all(t, F.lit(p.regex), F.lit(0))
        on = F.col("page").isin(*p.pages) if p.pages and "page" in keys else None
        if p.hint:
            on = t.rlike(p.hint) if on is None else on & t.rlike(p.hint)
        return m if on is None else F.when(on, m).otherwise(none)

    found = F.array(*[F.struct(F.lit(k).alias("k"), hits(p).alias("m")) for k, p in enumerate(patterns)])
    each = df.select(*keys, t.alias("_text"), F.explode(F.filter(found, lambda s: F.size(s["m"]) > 0)).alias("f"))
    between, name = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for k, p in enumerate(patterns):
        between = F.when(F.col("f.k") == k, F.split("_text", p.regex, -1)).otherwise(between)
        name = F.when(F.col("f.k") == k, p.name).otherwise(name)
    each = each.select(*keys, name.alias("type"), F.col("f.m").alias("m"), between.alias("between"))
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at("between", i)) + F.length(F.element_at("m", i))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(F.element_at("between", i)))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    spread = each.select(*keys, "type", F.posexplode(F.arrays_zip(F.col("m").alias("value"), starts.alias("start"))).alias("match_idx", "s"))
    value = F.col("s.value")
    return spread.select(*keys, "type", F.col("match_idx").cast("long").alias("match_idx"), value.alias("value"), F.col("s.start").cast("long").alias("start_off"), (F.col("s.start") + F.length(value)).cast("long").alias("end_off")).filter(F.length("value") > 0)


def hinted(text: Column, patterns: list[Pattern]) -> Column:
    """Whether a text may have matches: some pattern has no hint, or its hint is found. Hints stand within a line, so this holds for the pages of a text as well."""
    t, some = F.coalesce(text, F.lit("")), F.lit(False)
    for p in patterns:
        some = some | (t.rlike(p.hint) if p.hint else F.lit(True))
    return some


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each type: matches, distinct values (trimmed), documents."""
    return found.groupBy("type").agg(F.count("*").alias("n_matches"), F.countDistinct(F.trim("value")).alias("n_distinct"), F.countDistinct(key).alias("n_docs"))


def first_seen(found: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """For each document and type: count of distinct values, first samples and values in the order seen, pages. Blank values don't count."""
    order = [page, "start_off"]
    once = found.filter(F.trim("value") != "").groupBy(key, "type", F.trim("value").alias("value")).agg(F.min(F.struct(*order)).alias("first"), F.collect_set(page).alias("pages"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda s: s["value"])
    rolled = once.groupBy(key, "type").agg(F.count("*").alias("count"), ordered.alias("values"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    return rolled.select(key, "type", "count", F.slice("values", 1, SAMPLES).alias("samples"), F.slice("values", 1, VALUES).alias("values"), "pages")


def masked(df: DataFrame, patterns: list[Pattern], text: str = "text", mark: str = "█") -> DataFrame:
    """df with every match in a text replaced by a mark for each character; patterns are applied in their order.

    Each pattern is two projections of its own, so the plan grows by as much with every pattern.
    """
    for p in patterns:
        m = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
        df = df.withColumn("_hits", F.when(F.col(text).rlike(p.hint), m) if p.hint else m)
        blanks = F.transform("_hits", lambda x: F.repeat(F.lit(mark), F.length(x)))
        pieces = F.zip_with(F.split(text, p.regex, -1), blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        df = df.withColumn(text, F.when(F.size("_hits") > 0, F.array_join(pieces, "")).otherwise(F.col(text))).drop("_hits")
    return df


def scanned(text: Column) -> Column:
    """Whether a text is too short to be anything but a scan."""
    from inkveil.functions.patterns import java

    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), java("[{s}]+"), "")) < SCANNED


def total(found: DataFrame) -> DataFrame:
    """The number of distinct values of all types together, as first_seen() counts them."""
    return found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def supplied(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of a detector outside (key, page, seq, type, text) in the shape of first_seen(), with the tier ai; texts of one character are left out."""
    rows = found.filter(F.length(F.trim("text")) > 1).select(key, "page", F.col("seq").alias("start_off"), "type", F.col("text").alias("value"))
    return first_seen(rows, key).withColumn("tier", F.lit("ai"))
