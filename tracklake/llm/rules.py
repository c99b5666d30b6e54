"""Quality rules under weak supervision; DataFrame functions only.

Rules vote good or bad or abstain.  Expectation-maximisation over the votes of
the corpus estimates how each rule votes on good documents and on each kind of
bad ones, and a document is kept by its posterior probability of being good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import KEY, keyed_texts, read, staged

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_POSITION = (1 << 31) - 1


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_measures(docs: DataFrame) -> DataFrame:
    """Counts of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_bangs, n_stops, n_digits.

    Words are split at ASCII white space.  n_repeat_words counts the words inside
    3-word windows that occur twice or more in the text.  Window hashes are sorted
    once with their positions in the low bits; neighbours that agree in the high
    bits are candidates, and only those are compared by the whole hash.  A null or
    empty text has zeros.
    """
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    frame = keyed_texts(docs).select(
        "doc_id", KEY, words.alias("words"), lines.alias("lines"), F.length(_without(text, _SPACES)).cast("long").alias("word_chars"), (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, letters.upper()))).cast("long").alias("n_upper"), (F.length(text) - F.length(_without(text, letters + letters.upper()))).cast("long").alias("n_letters"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_bangs"), (F.length(text) - F.length(_without(text, ".,;:?"))).cast("long").alias("n_stops"), (F.length(text) - F.length(_without(text, "0123456789"))).cast("long").alias("n_digits"),
    )
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    frame = frame.select(
        "doc_id", KEY, "word_chars", "n_symbols", "n_upper", "n_letters", "n_bangs", "n_stops", "n_digits", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"),
    )
    packed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))))
    frame = frame.withColumn("packed", packed)

    def head(x: Column) -> Column:
        return F.shiftright(x, 31)

    near = F.filter("packed", lambda x, j: F.coalesce(head(x) == head(F.get("packed", j - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get("packed", j + 1)), F.lit(False)))
    frame = frame.withColumn("near", near)
    pairs = F.sort_array(F.transform("near", lambda x: F.struct(F.get("windows", x.bitwiseAND(F.lit(_POSITION)).cast("int")).alias("h"), x.bitwiseAND(F.lit(_POSITION)).cast("int").alias("p"))))
    frame = frame.withColumn("pairs", F.when(F.size("near") > 0, pairs)).drop("packed", "near", "windows")
    again = F.filter("pairs", lambda x, j: F.coalesce(x.h == F.get("pairs", j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("pairs", j + 1).h, F.lit(False)))
    frame = frame.withColumn("at", F.sort_array(F.transform(again, lambda x: x.p))).drop("pairs")
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


#: Kinds of bad documents, each with the rules that are made to see it; other rules see no one kind.
KINDS = {
    "junk": ("symbols", "symbol_characters", "letters", "word_length", "stops", "digits"),
    "repetition": ("words_repeat", "lines_repeat", "stops"),
    "shouting": ("capitals", "bangs", "words_repeat", "lines_repeat", "letters"),
}
VOTES = (1, 0, -1)


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, -1 abstain.  Bounds are set close, as a single complaint condemns no document."""

    def rate(x: Column, good: float, bad: float) -> Column:
        return F.when(x >= bad, 0).when(x <= good, 1).otherwise(-1)

    long, stops, letters = _share("word_chars", "n_words"), _share("n_stops", "n_words"), _share("n_letters", "word_chars")
    return {
        "word_length": F.when((long < 3.5) | (long > 8), 0).when(long.between(4, 7), 1).otherwise(-1),
        "stops": F.when((stops < 0.03) | (stops > 0.6), 0).when(stops.between(0.06, 0.3), 1).otherwise(-1),
        "digits": rate(_share("n_digits", "word_chars"), 0.02, 0.1),
        "symbols": rate(_share("n_symbols", "n_words"), 0.02, 0.2),
        "symbol_characters": rate(_share("n_symbols", "word_chars"), 0.005, 0.04),
        "letters": F.when(letters < 0.7, 0).when(letters >= 0.8, 1).otherwise(-1),
        "lines_repeat": rate(_share("n_dup_lines", "n_lines"), 0.05, 0.12),
        "words_repeat": rate(_share("n_repeat_words", "n_words"), 0.3, 0.45),
        "capitals": rate(_share("n_upper", "n_letters"), 0.1, 0.3),
        "bangs": rate(_share("n_bangs", "n_words"), 0.02, 0.2),
    }


def prior(names: list[str]) -> list[dict[str, tuple[float, ...]]]:
    """How each rule votes (good, bad, abstains) on good documents and on each kind of bad ones, before any is seen."""
    usual, sees = (0.85, 0.05, 0.1), (0.15, 0.7, 0.15)
    return [{n: usual for n in names}] + [{n: sees if n in own else usual for n in names} for own in KINDS.values()]


def estimate(patterns: list, names: list[str], weight: float = 2.0, close: float = 1e-7, most: int = 500) -> tuple[list[float], list[dict[str, tuple[float, ...]]]]:
    """Class shares and the rates of votes of each class, by expectation-maximisation.

    ``patterns`` holds each pattern of votes with its count n, at most 3 ** rules
    rows whatever the corpus.  Class 0 is good.  The prior counts as ``weight``
    documents in each class, so the votes decide as soon as there are some.  A rule
    has the same rates on all classes that it is not made to see, so a kind of bad
    documents differs from good ones by its own rules alone.  Runs until no share or
    rate moves by ``close`` (or ``most`` rounds).
    """
    rates = start = prior(names)
    share = expected = [0.7] + [0.3 / len(KINDS)] * len(KINDS)
    own = [(), *KINDS.values()]
    pools = {(c, name): [c] if name in own[c] else [k for k in range(len(own)) if name not in own[k]] for c in range(len(own)) for name in names}
    rows = [([VOTES.index(r[n]) for n in names], r["n"]) for r in patterns]
    total = sum(n for _, n in rows)
    for _ in range(most):
        sums = [[[0.0] * 3 for _ in names] for _ in rates]
        mass = [0.0] * len(rates)
        for votes, n in rows:
            odds = []
            for part, rate in zip(share, rates, strict=True):
                for name, v in zip(names, votes, strict=True):
                    part *= rate[name][v]
                odds.append(part)
            scale = n / sum(odds)
            for c, x in enumerate(odds):
                mass[c] += x * scale
                for j, v in enumerate(votes):
                    sums[c][j][v] += x * scale
        new_share = [(m + weight * x) / (total + weight) for m, x in zip(mass, expected, strict=True)]
        new_rates = [
            {name: tuple((sum(sums[k][j][v] for k in pools[c, name]) + weight * start[c][name][v]) / (sum(mass[k] for k in pools[c, name]) + weight) for v in range(3)) for j, name in enumerate(names)} for c in range(len(own))
        ]
        moved = max([abs(x - y) for x, y in zip(share, new_share, strict=True)] + [abs(x - y) for old, new in zip(rates, new_rates, strict=True) for n in names for x, y in zip(old[n], new[n], strict=True)])
        share, rates = new_share, new_rates
        if moved < close:
            break
    return share, rates


def _class_odds(names: list[str], share: list[float], rates: list[dict[str, tuple[float, ...]]]) -> list[Column]:
    """Unnormalised posterior of each class: its share times the chance of the votes given."""
    out = []
    for part, rate in zip(share, rates, strict=True):
        x = F.lit(part)
        for name in names:
            good, bad, silent = rate[name]
            x = x * F.when(F.col(name) == 1, good).when(F.col(name) == 0, bad).otherwise(silent)
        out.append(x)
    return out


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, base_failed, p_good and kept for each document.

    The model is estimated from the counts of vote patterns, one aggregation of the
    corpus; p_good is the posterior of the good class.  base_failed: fewer than 50
    words, or over half of the words inside repeated 3-word windows; kept needs
    both.  Null and empty texts have no words and fail; equal texts are judged
    equally, whatever their ids; no rows give no rows.
    """
    names = list(rules())
    measured = staged(text_measures(docs), "measures").withColumns(rules())
    patterns = measured.groupBy(*names).agg(F.count("*").alias("n")).collect()
    odds = _class_odds(names, *estimate(patterns, names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "p_good": odds[0] / sum(odds[1:], odds[0])}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """:func:`judge` over ``documents``."""
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
