"""Secret scans: fixed patterns, and a randomness test battery under false-discovery control."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.arrowtext import blocks
from tracklake.llm.common import KEY, keyed_texts, read, staged

Batches = Iterator[pa.RecordBatch]

# the key word is spelled with both cases so that only ASCII letters match, and starts with a class the scanner can skip to
_KEY_WORD = r"[pPsStTaA](?:(?<=[pP])[aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|(?<=[sS])[eE][cC][rR][eE][tT]|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])"
_ASSIGN = re.compile(_KEY_WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# '=' only as padding at the end, so that the value of name=value is a token of its own
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
KINDS = ("assign", "access", "hex", "random")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest; a token is read in the first that has all its characters.
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("lower", _LOWER), ("letters", _UPPER + _LOWER), ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
_P_GRID = 400  # p-values are rounded up to a grid of 400 steps of a twentieth in log10, so they stay valid


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(token: str) -> tuple[str, str]:
    body = set(token.rstrip("="))
    return next(((name, letters) for name, letters in ENCODINGS if body <= set(letters)), ("other", "".join(sorted(body))))


#: byte -> letter whatever its case (0-25), digit (26), separator inside tokens (27), anything else (28)
_SYMBOL = np.full(256, 28, np.uint8)
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = np.arange(26)
_SYMBOL[0x30:0x3A] = 26
_SYMBOL[[ord(c) for c in "+/_-"]] = 27
#: Letter frequencies of English text in per cent, a to z; with digits and separators, what is expected before a corpus shows its own pairs.
_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
_EXPECTED = np.array([0.9 * x / sum(_LETTERS) for x in _LETTERS] + [0.05, 0.05])
_WEIGHT = 1000  # pairs after each symbol that the expectation counts for
_MIXED = 0.25  # share of any symbol after any other, beside what the corpus shows
_TURN = 0.25  # chance that a letter has the other case than the letter before it


def pair_counts(texts: DataFrame) -> np.ndarray:
    """How often each symbol follows each other in the corpus, 29 by 29."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(29 * 29, np.int64)
        for _, data, offsets in blocks(batches):
            code = _SYMBOL[data].astype(np.int64)
            pair = code[:-1] * 29 + code[1:]
            pair[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = -1
            total += np.bincount(pair[pair >= 0], minlength=29 * 29)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.arange(29 * 29)), "n": pa.array(total)})

    out = np.zeros(29 * 29, np.int64)
    for r in texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(29, 29)


def text_model(counts: np.ndarray) -> np.ndarray:
    """Log chance of each symbol after each other inside a token of ordinary text, by the pairs of the corpus."""
    inside = counts[:, :28] + _WEIGHT * _EXPECTED
    return np.log((1 - _MIXED) * inside / inside.sum(1, keepdims=True) + _MIXED / 28)


def log_text(body: str, model: np.ndarray) -> float:
    """Log chance of a token under the text model: symbols by the one before, digits and separators alike, case by turns."""
    codes = _SYMBOL[np.frombuffer(body.encode(), np.uint8)]
    total = float(model[np.concatenate(([28], codes[:-1])), codes].sum()) - (codes == 26).sum() * math.log(10) - (codes == 27).sum() * math.log(4)
    upper = [c.isupper() for c in body if c.isalpha()]
    turns = sum(x != y for x, y in zip(upper, upper[1:], strict=False))
    return total + turns * math.log(_TURN) + max(0, len(upper) - 1 - turns) * math.log(1 - _TURN)


def battery(token: str) -> tuple[float, float, float]:
    """(p_uniform, p_runs, p_serial) of a token in its inferred encoding: the chance in a random string of so uneven an
    alphabet, so odd a number of runs above and below the middle code, so strong a correlation of neighbours."""
    _, letters = infer_encoding(token)
    body = token.rstrip("=")
    n, k = len(body), len(letters)
    place = {c: i for i, c in enumerate(letters)}
    codes = np.array([place[c] for c in body])
    chi = float(((np.bincount(codes, minlength=k) - n / k) ** 2).sum() * k / n)
    df = k - 1
    p_uniform = _normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if chi > 0 else 1.0
    above = codes >= (k - 1) / 2
    a = int(above.sum())
    b = n - a
    if not a or not b:
        p = 2.0 ** (1 - n)
        return p_uniform, p, p
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = 2 * _normal_tail(abs(runs - mean) / spread)
    x = codes - codes.mean()
    p_serial = 2 * _normal_tail(abs(float((x[1:] * x[:-1]).sum() / max(1e-9, (x * x).sum())) + 1 / n) * math.sqrt(n))
    return p_uniform, p_runs, p_serial


def combined(ps: tuple[float, ...]) -> float:
    """Fisher's combination of the battery: one p-value for randomness."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


def p_text(token: str, model: np.ndarray) -> float:
    """Chance that ordinary text looks so random, 1 for numbers and for tokens that the battery rejects as random at 0.001.

    The likelihood ratio of the text model to a random string of the inferred
    encoding: by Markov's inequality a p-value as it stands, sharper with length.
    """
    name, letters = infer_encoding(token)
    body = token.rstrip("=")
    if name in ("decimal", "other") or combined(battery(token)) < 0.001:
        return 1.0
    return math.exp(min(0.0, log_text(body, model) + len(body) * math.log(len(letters))))


def length_class(n: int) -> int:
    """16-31, 32-47, ... characters, then 128-255, 256-511, ..."""
    return n // 16 if n < 128 else n.bit_length()


def _scan(text: str, model: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (start, kind, end) and candidates (start, end, length class, step of p_text)."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found = []
    for m in _CANDIDATE.finditer(text):
        token = m.group()
        step = min(_P_GRID - 1, int(-20 * math.log10(max(p_text(token, model), 1e-19))))
        found.append((m.start(), m.end(), length_class(len(token)), step))
    return spans, found


def _clear_of(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of the (start, kind, end) spans, by bisection."""
    spans = sorted(spans)
    starts = [s for s, _, _ in spans]
    reach = list(itertools.accumulate((e for _, _, e in spans), max))

    def free(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return free


def _thresholds(histogram: list, q: float) -> dict[int, int]:
    """Benjamini-Hochberg within each length class, on the p grid: least step that counts as a discovery."""
    by: dict[int, dict[int, int]] = {}
    for r in histogram:
        by.setdefault(r.length, {})[r.step] = r.n
    out = {}
    for length, steps in by.items():
        total, seen, best = sum(steps.values()), 0, _P_GRID
        for step in sorted(steps, reverse=True):
            seen += steps[step]
            if 10 ** (-step / 20) <= q * seen / total:  # the upper edge of the step
                best = step
        out[length] = best
    return out


def scan_secrets(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """Secrets of each document: fixed patterns, and random-looking tokens at a false-discovery rate ``q``.

    Kinds assign, access and hex are the patterns.  Every other unbroken token of 16
    or more characters is tested (:func:`p_text`); those that pass Benjamini-Hochberg
    among all tokens of their length class in the corpus are ``random``, unless they
    overlap a base span.  Two passes over the texts: pairs of symbols, then tokens;
    only 29 by 29 counts and a histogram of (class, p step) reach the driver.
    Returns doc_id, row key, n_assign, n_access, n_hex, n_random, base_spans and
    spans (kind:start:end in code points, by start and kind, comma-joined).  Null
    and empty texts have none; equal rows have equal spans, whatever their ids; no
    rows give no rows.  A very long text is scanned whole by one task, in time that
    grows with its length and its spans.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    model = spark.sparkContext.broadcast(text_model(pair_counts(texts.select("text"))))

    def scan(batches: Batches) -> Batches:
        for rows in batches:
            base, more = [], []
            for text in rows.column("text"):
                spans, found = _scan(text.as_py(), model.value)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                more.append([{"start": s, "end": e, "length": c, "step": p} for s, e, c, p in found])
            number = pa.int32()
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), KEY: rows.column(KEY), "base": pa.array(base, pa.list_(pa.struct([("start", number), ("kind", number), ("end", number)]))),
                "more": pa.array(more, pa.list_(pa.struct([("start", number), ("end", number), ("length", number), ("step", number)]))),
            })

    scanned = staged(texts.mapInArrow(scan, f"doc_id long, {KEY} long, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,length:int,step:int>>"), "secrets")
    histogram = scanned.select(F.explode("more").alias("m")).groupBy("m.length", "m.step").agg(F.count("*").alias("n")).collect()
    least = spark.sparkContext.broadcast(_thresholds(histogram, q))

    def settle(batches: Batches) -> Batches:
        for rows in batches:
            counts: tuple[list, ...] = ([], [], [], [])
            texts: tuple[list, list] = ([], [])
            for base, more in zip(rows.column("base").to_pylist(), rows.column("more").to_pylist(), strict=True):
                spans = [(x["start"], x["kind"], x["end"]) for x in base]
                free = _clear_of(spans)
                added = [(x["start"], 3, x["end"]) for x in more if x["step"] >= least.value.get(x["length"], _P_GRID) and free(x["start"], x["end"])]
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in spans))
                counts[3].append(len(added))
                for out, some in zip(texts, (spans, spans + added), strict=True):
                    out.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(some)))
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), KEY: rows.column(KEY)} | {n: pa.array(c, pa.int64()) for n, c in zip(("n_assign", "n_access", "n_hex", "n_random"), counts, strict=True)} | {n: pa.array(t, pa.string()) for n, t in zip(("base_spans", "spans"), texts, strict=True)})

    return scanned.mapInArrow(settle, f"doc_id long, {KEY} long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """:func:`scan_secrets` over ``documents``, with a digest of the base spans."""
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")
