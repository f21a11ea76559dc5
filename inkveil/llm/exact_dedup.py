"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (three letters of a fixed class in a row), so equal passages give equal
chunks wherever they stand. Chunks become identifiers: a 64-bit hash, verified over all chunks by their SHA-256 digests;
if some hash stands for two different chunks, the digests are the identifiers instead. A
document is then the ordered list of its identifiers, and only these lists (eight bytes a chunk) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.session import Scratch

#: After the shortest length a chunk ends behind the first three of these letters in a row, at the longest length at last.
SHORTEST, LONGEST = 768, 4096
CUT_LETTERS = "anotANOT"
#: Up to so many bytes of groups with copies are broadcast; beyond it the rows are shuffled by their recipes.
BROADCAST_BYTES = 32 << 20


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text as an array of content-defined chunks; their concatenation is the text. An empty text has none."""
    cut = f"(?<=[{CUT_LETTERS}]{{3}})"
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{shortest},{longest - 1}}}?{cut}|.{{1,{longest}}}"), F.lit(0))


def clashes(hashed: DataFrame) -> DataFrame:
    """Hashes that stand for more than one chunk: (hash, n). Usually none.

    hashed has an array column chunks. Each chunk sends its hash and digest, never its text; equal chunks are
    combined before the shuffle.
    """
    each = hashed.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("hash"), F.unhex(F.sha2("chunk", 256)).alias("digest"))
    known = each.groupBy("hash", "digest").agg(F.lit(1).alias("one"))
    return known.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", shortest: int = SHORTEST, longest: int = LONGEST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df's rows and columns, and keep_id, group_size, kept, text_sha256. A df of text and order only gives no text back.

    Rows are equal when their texts are identical; null counts as empty. Of equal rows the one with the largest
    value of order stays (null is the smallest). If several rows share that value, the one with the largest hash of
    all its columns stays, and of rows identical in all columns any one: exactly one row of a group is kept. An
    empty table gives an empty result. Columns of df that are named like the new ones are replaced.
    """
    new = ("keep_id", "group_size", "kept", "text_sha256")
    df = df.drop(*new)
    mine = [c for c in df.columns if c not in (text, order)]
    rows = df.select(F.struct(*df.columns).alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    cut = rows.withColumn("chunks", chunks(F.col("_text"), shortest, longest))
    scratch = Scratch(df.sparkSession, "exact-dedup")
    # identifiers are hashes as long as each stands for one chunk; else, for all chunks, their digests
    sure = clashes(cut.select("chunks")).isEmpty()
    recipe = F.transform("chunks", lambda c: F.xxhash64(c)) if sure else F.transform("chunks", lambda c: F.sha2(c, 256))
    tie = F.struct(F.col(f"_row.`{order}`").alias("id"), F.xxhash64(*[F.col(f"_row.`{c}`") for c in (order, *mine)]).alias("h"), F.monotonically_increasing_id().alias("n"))
    listed = cut.select("_row", F.sha2("_text", 256).alias("text_sha256"), recipe.alias("_recipe"), tie.alias("_tie"))
    listed = scratch.save(listed.select("_recipe", "_tie", "text_sha256", *([] if _slim(df, text, order) else ["_row"])), "recipes")
    groups = listed.groupBy("_recipe").agg(F.max("_tie").alias("_keep"), F.count("*").alias("group_size"))
    # single texts need no partner: only groups of several are joined back
    repeated = groups.filter("group_size > 1").select(F.xxhash64("_recipe").alias("_key"), F.col("_recipe").alias("_theirs"), "_keep", "group_size")
    repeated = scratch.save(repeated, "repeated")
    weight = repeated.agg(F.coalesce(F.sum((8 if sure else 80) * F.size("_theirs") + 100), F.lit(0))).first()[0]
    if weight <= broadcast_bytes:
        repeated = F.broadcast(repeated)
    joined = listed.withColumn("_mine", F.xxhash64("_recipe")).join(repeated, (F.col("_mine") == F.col("_key")) & (F.col("_recipe") == F.col("_theirs")), "left")
    stays = F.coalesce(F.col("_tie") == F.col("_keep"), F.lit(True))
    out = [F.coalesce("_keep", "_tie")["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.col("text_sha256")]
    if _slim(df, text, order):
        return joined.select(F.col("_tie.id").alias(order), *out)
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns], *out)


def _slim(df: DataFrame, text: str, order: str) -> bool:
    """Whether the caller asks for decisions only: the table holds nothing but the key and the text."""
    return set(df.columns) == {text, order}
