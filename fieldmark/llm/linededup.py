"""Line dedup over windows of three lines.

Every three consecutive lines that are not blank form a window, and windows overlap. So that short texts and long lines are not
missed, a text of fewer lines is one window as a whole, and a line of over fifty words is one by itself. A window that stands in several
places of the corpus keeps its first place, by document and position; the lines that later places cover are merged and removed. Windows
travel as two 64-bit hashes with a document id and three line numbers; texts stay where they are, but those that lose lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, map_rows, quoted, settled, stash, unused, without

#: Removed rows and lines up to which they are broadcast as they are, and rows up to which at least their ids are.
BROADCAST_LINES, BROADCAST_IDS = 50 * BROADCAST_ROWS, 50 * BROADCAST_ROWS
#: Words above which a line is a window of its own.
LONG_LINE = 50


def _windows(text: Column, lines: int, long_line: int) -> tuple[Column, Column]:
    """Array of (w1, w2, at): the hashes of each window and the numbers of its lines in the text. A-Z are folded, and white space
    at both ends of a line does not count."""
    normal = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" \t\r\x0b\x0c")).alias("line")))
    full = F.filter(normal, lambda x: x["line"] != "")

    def hashed(size: int, held: list[Column], at: Column) -> Column:
        return F.struct(F.xxhash64(*held).alias("w1"), F.xxhash64(F.lit(size), *reversed(held)).alias("w2"), at.alias("at"))

    def window(k: Column) -> Column:
        rows = [F.get(F.col("__full"), k + i) for i in range(lines)]
        return hashed(lines, [x["line"] for x in rows], F.array(*[x["at"] for x in rows]))

    none = F.array().cast("array<int>")
    starts = F.when(F.size("__full") >= lines, F.sequence(F.lit(0), F.size("__full") - lines)).otherwise(none)
    found = F.transform(starts, window)
    if lines > 1:
        # A whole text of fewer lines: their number is part of the hash, so it only ever equals a text of as many.
        short = F.struct(F.xxhash64("__full.line").alias("w1"), F.xxhash64(F.lit(-1), F.size("__full"), F.col("__full.line")).alias("w2"), F.col("__full.at").alias("at"))
        found = F.when(F.size("__full").between(1, lines - 1), F.array(short)).otherwise(found)
        long = F.filter("__full", lambda x: (F.octet_length(x["line"]) > long_line) & (F.octet_length(x["line"]) - F.octet_length(F.replace(x["line"], F.lit(" "))) >= long_line))
        found = F.concat(found, F.transform(long, lambda x: hashed(1, [x["line"]], F.array(x["at"]))))
    return full, found


def repeated_lines(docs: DataFrame, *, lines: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, text_hash, removed): the line numbers to remove, ascending, of each document of ``docs(doc_id, text)`` that has any.

    Rows of one doc_id and text are one document; of one doc_id with several texts each is a document. Null and blank texts, and rows
    without a doc_id, lose nothing, and nothing is lost for them. A line is long if it holds ``long_line`` spaces or more.
    """
    full, windows = _windows(F.col("text"), lines, long_line)
    cut = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), full.alias("__full"))
    # Written, so that texts are read and hashed once for both sides of the join.
    seen = stash(cut.select("doc_id", "text_hash", F.explode(windows).alias("w")).select("doc_id", "text_hash", "w.*"))
    seen = seen.select("w1", "w2", F.struct("doc_id", "text_hash", F.element_at("at", 1).alias("first")).alias("place"), "at")
    first = seen.groupBy("w1", "w2").agg(F.min("place").alias("kept"), F.max("place").alias("last")).where("kept <> last").select("w1", "w2", "kept")
    later = seen.join(first, ["w1", "w2"]).where("place <> kept")
    return later.groupBy("place.doc_id", "place.text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("removed"))


def dedup_lines(docs: DataFrame, *, lines: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """``docs`` with the text that is left, ``n_lines`` (of the text as it was; 0 if null) and ``removed_lines`` (their numbers
    from 0). See :func:`repeated_lines`; input columns of the added names are replaced.

    Removed lines are broadcast if they are few; else their documents' ids are, and only those documents are shuffled to meet
    their lines; all are only if even the ids are too many.
    """
    docs = without(docs, "n_lines", "removed_lines")
    removed = settled(lambda: repeated_lines(docs.select("doc_id", "text"), lines=lines, long_line=long_line))
    names = docs.columns
    id_, hash_, hashed = unused(docs, "id", "h", "hashed")
    counted = docs.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))), hashed: F.xxhash64("text")})
    side = removed.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("removed").alias("removed_lines"))
    same = (F.col("doc_id") == F.col(id_)) & (F.col(hashed) == F.col(hash_))
    few = removed.agg(F.count("*").alias("n"), F.sum(F.size("removed")).alias("lines")).first()
    none = F.array().cast("array<int>")
    if few.n + (few.lines or 0) <= BROADCAST_LINES:
        joined = counted.join(F.broadcast(side), same, "left")
    elif few.n <= BROADCAST_IDS:
        ids = F.broadcast(side.select(id_, hash_))
        rest = counted.join(ids, same, "left_anti").withColumn("removed_lines", none)
        joined = counted.join(ids, same, "left_semi").join(side, same).unionByName(rest, allowMissingColumns=True)
    else:
        joined = counted.join(side, same, "left")
    joined = joined.select(*[F.col(quoted(c)) for c in names], "n_lines", F.coalesce("removed_lines", none).alias("removed_lines"))
    at = names.index("text")

    def rebuild(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = batch.columns
        text, gone = columns[at], columns[len(names) + 1]
        touched = [i for i, n in enumerate(gone.value_lengths().to_pylist()) if n]
        if touched:
            texts = text.to_pylist()
            for i in touched:
                out = set(gone[i].as_py())
                texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in out)
            columns[at] = pa.array(texts, text.type)
        return columns

    return map_rows(joined, rebuild, joined.schema.fields)
