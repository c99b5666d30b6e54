"""Line dedup: content-defined chunks of lines, repeated passages removed; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import KEY, discard, keyed_texts, packed, read, release, staged
from tracklake.operators.skew import join_to_one

_WORD = r"[^\x20\x09-\x0D]"
_PLACE = ["doc_id", KEY, "start", "size"]


def _body(w: Column) -> Column:
    return F.array_join(F.slice("lines", w.start + 1, w["size"]), "\n")


def _window(start: Column, size: Column, h: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), size.cast("int").alias("size"), h.alias("h"))


def _lined(texts: DataFrame) -> DataFrame:
    """texts with lines, their hashes, and whether each has a character other than white space."""
    lined = texts.withColumn("lines", F.split("text", "\n")).drop("text")
    return lined.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("full", F.transform("lines", lambda x: x.rlike(_WORD)))


def _chunks(lined: DataFrame, divisor: int) -> DataFrame:
    """The multi-line chunks of each text.

    The rolling hash of a line covers it and the line before; a chunk ends where
    that hash is 0 modulo ``divisor`` and at the end of the text.  Boundaries
    depend on two lines only, so text put in before a passage does not move the
    boundaries inside it.
    """
    n = F.size("lines")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.xxhash64(F.get("hashes", i - 2), F.get("hashes", i - 1)), F.lit(divisor)) == 0))
    lined = lined.withColumn("ends", ends)
    spans = F.transform("ends", lambda e, k: F.struct(F.coalesce(F.get("ends", k - 1), F.lit(0)).alias("start"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("size")))
    spans = F.filter(spans, lambda s: (s["size"] > 1) & F.exists(F.slice("full", s.start + 1, s["size"]), lambda f: f))
    return lined.select("doc_id", KEY, "lines", F.transform(spans, lambda s: _window(s.start, s["size"], F.xxhash64(_body(s)))).alias("wins"))


def _rims(lined: DataFrame) -> DataFrame:
    """The windows outside of repeated chunks, ``inner`` being the line numbers whose next line lies in the same repeated chunk.

    A window is two neighbouring lines of which one has a character other than
    white space, or, where blank lines would else lie outside all of these, two such
    lines (or one and an end of the text) with the blank lines between.  A repeated
    passage of two or more lines is the union of its repeated chunks and windows,
    whatever stands around it.
    """
    n = F.size("lines")
    starts = F.array_except(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), F.coalesce("inner", F.array().cast("array<int>")))
    lined = lined.withColumn("starts", F.filter(starts, lambda i: F.get("full", i) | F.get("full", i + 1)))
    pairs = F.transform("starts", lambda i: _window(i, F.lit(2), F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1))))
    lined = lined.withColumn("at", F.filter(F.transform("full", lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    last = F.size("at")
    gaps = F.transform(F.concat(F.array(F.lit(0)), "at"), lambda s, k: F.struct(s.alias("start"), (F.when(k < last, F.get("at", k)).otherwise(n - 1) - s + 1).alias("size"), ((k == 0) | (k == last)).alias("edge")))
    gaps = F.filter(gaps, lambda w: (last > 0) & (w["size"] > F.when(w.edge, 2).otherwise(4)))
    gaps = F.transform(gaps, lambda w: _window(w.start, w["size"], F.xxhash64(_body(w))))
    return lined.select("doc_id", KEY, "lines", F.concat(pairs, gaps).alias("wins"))


def _repeated(windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, row key, start, size): windows whose bytes stand in an earlier place too.

    Hashes are counted first, without text; only windows with a repeated hash carry
    their text on, where grouping by the text itself compares the bytes.  The
    repeated hashes are broadcast only up to ``broadcast_rows`` of them (a few MB);
    beyond that the windows meet them by a join that splits hot keys, without text,
    and fetch their text by document.  The first place of each group is taken out by
    place, so a passage that is everywhere is no key of a join.
    """
    spark = windows.sparkSession
    # explode an expression: for a bare column Spark puts a filter on its size first, with the whole computation written into each lambda
    bare = windows.select("doc_id", KEY, F.explode(F.transform("wins", lambda w: _window(w.start, w["size"], w.h))).alias("w")).select("doc_id", KEY, "w.*")
    again = staged(bare.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-hashes")
    release(spark)

    def bodies(some: DataFrame) -> DataFrame:
        full = F.transform("wins", lambda w: F.struct(w.start.alias("start"), w["size"].alias("size"), w.h.alias("h"), _body(w).alias("body")))
        return some.select("doc_id", KEY, F.explode(full).alias("w")).select("doc_id", KEY, "w.*")

    steps = [again]
    if again.count() <= broadcast_rows:
        found = bodies(windows).join(F.broadcast(again.select("h")), "h", "left_semi")
    else:
        places = staged(bare, "line-places")
        steps.append(places)
        wanted = join_to_one(places, again.select("h"), "h", _PLACE, "left_semi", sizes=again).groupBy("doc_id", KEY).agg(F.collect_set(F.struct("start", "size", "h")).alias("wins"))
        found = bodies(windows.drop("wins").join(wanted.hint("merge"), ["doc_id", KEY]))
    seen = staged(found.select(*_PLACE, "h", "body"), "line-windows")
    first = seen.groupBy("h", "body").agg(F.min(F.struct(*_PLACE)).alias("first")).select("first.*")
    out = staged(seen.select(*_PLACE).distinct().join(first.hint("merge"), _PLACE, "left_anti"), "line-repeats")
    discard(seen, *steps)
    release(spark)
    return out


def _numbers(first: Column, last: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(F.sequence(first, last))))


def repeated_lines(docs: DataFrame, divisor: int = 4, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row key, start, size) of repeated chunks, and of repeated windows outside of them.

    An earlier place is one in a document with a smaller doc_id, or further up in the
    same text.  Chunks between content-defined boundaries are compared first; the
    lines around repeated chunks, and passages too short for a chunk, window by window.
    """
    texts = keyed_texts(docs).where("doc_id IS NOT NULL")
    chunks = _repeated(_chunks(_lined(texts), divisor), broadcast_rows)
    inner = chunks.groupBy("doc_id", KEY).agg(_numbers(F.col("start"), F.col("start") + F.col("size") - 2).alias("inner"))
    rims = _lined(texts.join(inner.hint("merge"), ["doc_id", KEY], "left"))
    return chunks, _repeated(_rims(rims), broadcast_rows)


def _gone(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``gone``, the numbers of the lines that repeated chunks and windows cover, in order."""
    both = DataFrame.unionByName(*repeated_lines(docs))
    return both.groupBy(*keys).agg(_numbers(F.col("start"), F.col("start") + F.col("size") - 1).alias("gone")).withColumn("gone", F.array_sort("gone"))


def _kept() -> Column:
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row key, n_lines, n_removed, n_chunks, kept_text for each document.

    Every occurrence of a passage of two or more lines but its first is removed with
    its line ends; n_chunks counts the runs of lines that go.  Single lines and lines
    of white space alone stay, and so does the earliest place of each line.  An empty
    or null text has one empty line; a row without a doc_id loses nothing.  Rows that
    repeat a doc_id and text are one place, so both stay or lose the same; rows with
    one doc_id and other texts follow in the order of their row keys.  No rows give
    no rows.
    """
    gone = _gone(docs, "doc_id", KEY).select(F.col("doc_id").alias("gone_doc"), F.col(KEY).alias("gone_key"), "gone")
    texts = keyed_texts(docs)
    # by merge at every size: what was removed grows with the corpus and is never broadcast
    both = texts.join(gone.hint("merge"), (texts.doc_id == gone.gone_doc) & (texts[KEY] == gone.gone_key), "left").drop("gone_doc", "gone_key")
    lines = both.withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept())
    runs = F.size(F.filter("gone", lambda x, k: F.coalesce(F.get("gone", k - 1) < x - 1, F.lit(True))))
    return lines.select("doc_id", KEY, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(runs, F.lit(0)).cast("long").alias("n_chunks"), kept.alias("kept_text"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from text, all other columns as they were but n_chars, which is kept true.

    A document left without a word goes, but only if it lost lines; empty and null
    texts and rows without a doc_id stay.  See :func:`dedup_lines` for what repeats.
    """
    gone = _gone(docs, KEY).select(F.col(KEY).alias("gone_key"), "gone")
    both = packed(docs)
    both = both.join(gone.hint("merge"), both[KEY] == gone.gone_key, "left").withColumn("lines", F.split("text", "\n"))
    cut = both.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept()))
    cut = cut.where(F.col("gone").isNull() | F.col("text").rlike(_WORD)).withColumn("row", F.col("row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(kind))))
    return cut.select("row.*")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`dedup_lines` over ``documents``, with a digest in place of the kept text."""
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("kept_text", 256).alias("kept_sha256"))
