"""Exact copies by content-defined chunk recipes, with DataFrame functions only.

White space is deleted from a text and the rest is cut where its own characters say
so: after at least ``LEAST`` code points, behind three characters of fixed classes.
A chunk's identifier is a 64-bit hash, and a document's recipe is the ordered list of
its identifiers, a small part of the text's size. Recipes are grouped, and only
documents whose recipe occurs again are looked at further: their chunks are put into
a dictionary once each, and an identifier that stands for two different chunks gets
numbers that tell them apart. So equal recipes of verified identifiers are equal
texts, byte for byte, while no text moves but the distinct chunks of likely copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, few

SPACE = r"[\x20\x09-\x0D]+"
LEAST, MOST = 48, 1024  # code points of a chunk
#: What stands before a cut: a common vowel, a common consonant, a vowel (Latin, Cyrillic), or an ideograph of one in 64.
_HAN = "".join(f"\\u{c:04x}-\\u{c + 15:04x}" for c in range(0x4E00, 0xA000, 0x400))
BEFORE_CUT = f"(?:[eao][nrst][aeiou]|[\\u043e\\u0435\\u0430][\\u043d\\u0442\\u0441\\u0440\\u0432][\\u0430\\u0435\\u0438\\u043e\\u0443]|[{_HAN}])"
CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?<={BEFORE_CUT})|.{{1,{MOST}}}"
OFTEN, SHORT = 1 << 12, 1 << 8  # groups with more than one in OFTEN rows, and the chunks of one that may be sent to all tasks


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def chunks(norm: Column) -> Column:
    """The chunks of a text in order; they add up to it. A text without cut places is cut every MOST code points."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def _numbered(likely: DataFrame, bits: int) -> DataFrame | None:
    """(id, chunk, number) of identifiers that stand for several chunks; None if there are none.

    ``likely`` has a column norm. Equal chunks are combined before they move.
    """
    seen = likely.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(_identifier(F.col("chunk"), bits).alias("id"), "chunk").distinct()
    seen = seen.withColumn("size", F.octet_length("chunk"))
    several = cut(seen.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"))
    if several.isEmpty():
        return None
    order = Window.partitionBy("id").orderBy("chunk")
    return cut(seen.join(several, "id", "leftsemi").select("id", "chunk", F.row_number().over(order).cast("long").alias("number")))


def _renamed(likely: DataFrame, numbers: DataFrame, bits: int) -> DataFrame:
    """Rows of likely copies whose recipes hold (identifier, number) of every chunk."""
    rows = cut(likely.withColumn("row", F.monotonically_increasing_id()))
    at = rows.select("row", F.posexplode_outer(chunks(F.col("norm"))).alias("pos", "chunk")).withColumn("id", _identifier(F.col("chunk"), bits))
    at = at.join(numbers, ["id", "chunk"], "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", F.coalesce("number", F.lit(0).cast("long")).alias("number")))
    lists = at.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("items"))  # one document's chunks
    recipe = F.flatten(F.transform("items", lambda x: F.array(x["id"], x["number"])))
    return rows.join(lists, "row").withColumn("recipe", recipe).drop("row", "items", "norm")


def _groups(rows: DataFrame) -> DataFrame:
    """Recipes that occur twice or more, with their number of rows and the row that stays."""
    first = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    return rows.groupBy("key", "recipe").agg(F.count("*").alias("group_size"), first).where("group_size > 1")


def copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical without spaces and the characters from
    tab to carriage return; a null text is an empty one, and empty texts are equal. Of
    equal texts the row with the most code points before deletion stays, then the
    smallest id (a null one last), then one of the rows that are equal in both. An empty
    table gives no rows; other columns are ignored. ``bits`` is the width of chunk
    identifiers; the result is the same whatever it is.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"), normal(F.col("text")).alias("norm"))
    base = base.withColumn("mark", F.xxhash64("norm"))
    named = base.withColumns({"text_sha256": F.sha2("norm", 256), "recipe": F.transform(chunks(F.col("norm")), lambda c: _identifier(c, bits))})

    def keyed(df: DataFrame) -> DataFrame:
        return cut(df.select("doc_id", "n_chars", "mark", "text_sha256", "recipe", F.xxhash64("recipe").alias("key"), F.monotonically_increasing_id().alias("row")))

    rows = keyed(named.drop("norm"))
    groups = cut(_groups(rows))
    # the documents whose recipe occurs again, by a hash of their texts, so that only those are cut once more
    marks = rows.select("key", "mark").distinct().join(groups.select("key").distinct(), "key", "leftsemi").select("mark").distinct()
    marks = cut(marks)
    numbers = _numbered(base.join(few(marks), "mark", "leftsemi"), bits)
    if numbers is not None:
        again = _renamed(named.drop("recipe").join(few(marks), "mark", "leftsemi"), numbers, bits)
        rows = keyed(rows.join(few(marks), "mark", "leftanti").drop("key", "row").unionByName(again))
        groups = cut(_groups(rows))
    # groups that hold many rows are few: their recipes are sent to all tasks and their rows stay where they are
    hot = (F.col("group_size") * OFTEN > rows.count()) & (F.size("recipe") <= SHORT)
    at = rows.join(F.broadcast(groups.where(hot)), ["key", "recipe"], "left")
    cold = at.where("group_size is null").drop("group_size", "first").join(groups.where(~hot), ["key", "recipe"], "left")
    every = at.where("group_size is not null").unionByName(cold)
    return every.select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"),
    )
