"""Line deduplication: lines that stand in many documents go from all of them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Tables, cut

LEAST_DOCS = 10
LEAST_CHARS = 1
#: ASCII white space that is stripped from both ends of a line.
BLANKS = "\t\n\x0b\x0c\r "
#: The most frequent lines, which are broadcast: any other one has at most this part of all frequent lines' places.
HOT_LINES = 1000
#: Rows up to which the table of frequent lines, and bytes up to which the table of dropped places, is broadcast.
MOST_LINES, MOST_BYTES = 1 << 18, 16 << 20


def _keys(text: Column) -> Column:
    """The key of each line of text: stripped of blanks, only A-Z lower-cased (lower() does no more to plain ASCII)."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.transform(F.split(lower, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _digest(x: str, name: str) -> list[Column]:
    """128 bits of a string, as two columns."""
    return [F.xxhash64(x).alias(f"{name}1"), F.xxhash64(F.lit(name), x).alias(f"{name}2")]


def frequent_lines(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, n): digest and number of documents of each line key in least_docs rows of docs or more. Counted with map-side combining."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.explode(F.array_distinct(_keys(text))).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select(*_digest("key", "h")).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs)


def _places(rows: DataFrame, frequent: DataFrame, least_chars: int) -> DataFrame:
    """(t1, t2, pos): digest of a text and the place of a frequent line in it, from rows (t1, t2, text)."""
    lines = rows.select("t1", "t2", F.posexplode(_keys(F.col("text"))).alias("pos", "key")).filter(F.char_length("key") >= least_chars).select("t1", "t2", "pos", *_digest("key", "h"))
    if frequent.count() <= MOST_LINES:
        return lines.join(F.broadcast(frequent), ["h1", "h2"], "left_semi").select("t1", "t2", "pos")
    # the hottest lines are found by broadcast and dealt out at random, the others meet by their digest
    hot = frequent.orderBy(F.desc("n"), "h1", "h2").limit(HOT_LINES).select("h1", "h2", F.lit(True).alias("hot"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("h2", F.when(F.col("hot"), F.xxhash64("t1", "pos")).otherwise(F.col("h2")))
    cool = frequent.join(F.broadcast(hot), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(True).alias("cool"))
    return marked.join(cool, ["h1", "h2"], "left").filter("hot or cool").select("t1", "t2", "pos")


def drop_repeated_lines(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of docs with the lines that stay as text, joined by line feeds, and n_lines (before), n_dropped.

    Texts are split at line feeds; a null or empty text is one empty line. A line's key is the line without ASCII
    white space at both ends, A-Z lower-cased. Keys of least_chars code points or more that are in least_docs
    documents or more lose all their lines in every document. Each row is a document, also one that repeats another
    or has no id. Columns of docs named n_lines or n_dropped are replaced; other names don't matter. An empty table
    gives an empty result.

    Lines are exploded and counted by 128-bit digests, once a document; places of frequent lines come back by the
    digest of the text, so that equal texts share them, and lines are put together again by position. Neither table
    is broadcast beyond a checked size: then lines meet by digest, but for the hottest, and texts by theirs.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    tables = Tables(docs.sparkSession, "lines")
    frequent = tables.keep(frequent_lines(docs, text_col, least_docs, least_chars))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own if c != text_col)).alias("row") if len(own) > 1 else F.lit(None).alias("row"), text.alias("text"))
    rows = rows.select("row", "text", *_digest("text", "t"))
    places = _places(rows.select("t1", "t2", "text"), frequent, least_chars)
    dropped = cut(places.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("dropped")))
    tables.drop()
    size = dropped.agg(F.sum(F.size("dropped") * 4 + 64)).first()[0] or 0
    split = rows.select("row", "t1", "t2", F.split("text", "\n", -1).alias("lines"))
    found = split.join(F.broadcast(dropped) if size <= MOST_BYTES else dropped, ["t1", "t2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    left = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i)))
    return found.select(
        *(F.array_join(left, "\n").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in own),
        F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
