"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking.

A token sequence is the one that greedy merging would give exactly when each two
neighbours, joined and merged again on their own, come out as the same two tokens
(a merge that crosses a border in the whole text would cross it there as well).
So the encoder walks the text with the longest match of an Aho-Corasick automaton,
checks each new token against its left neighbour, falls back to shorter matches,
and marks in a bitfield the positions from which no continuation fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm.common import keyed_texts, read

MARK = "▁"
_SCHEMA = "doc_id long, n_tokens long, ids_text string, ids_sha256 string, decoded string, decoded_sha256 string"
_CACHE = 300_000
_LONGEST_CACHED = 48


class _Remembered(dict):
    """Bounded memo in two generations: ``make`` fills misses; when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _LONGEST_CACHED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("Ａ  ﬁ ") != f"{MARK}Ａ{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("only models with identity normalisation and a leading space mark are supported")
        self.eos = model.eos_id()
        n = model.get_piece_size()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.of_byte = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.rank = {self.names[i]: -model.get_score(i) for i in normal}
        if any(MARK in self.names[i].lstrip(MARK) for i in normal) or any("\n" in self.names[i] for i in normal):
            raise ValueError("pieces that reach over a space or line end are not supported")
        self.matches = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.matches.add_word(name, (len(name), i))
        self.matches.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.encoded = _Remembered(self._encode_part, _CACHE)
        self.spelled = {str(i): self._spell(i) for i in range(n)}

    def remerge(self, text: str) -> list[str]:
        """Plain greedy merging: the pair whose union ranks best is joined, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= _CACHE:
                self.fits.clear()
            known = self.fits[left, right] = self.remerge(left + right) == [left, right]
        return known

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text whose spaces are marks already; characters outside the vocabulary stand alone."""
        n = len(text)
        options: list[list[int]] = [[] for _ in range(n)]
        for end, (size, _) in self.matches.iter(text):
            options[end + 1 - size].append(size)  # ends ascend, so sizes at one start ascend
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        tried: list[int] = []  # for each token, how many longer options were passed over
        at, passed = 0, 0
        while at < n:
            sizes = options[at] or [1]
            for k in range(passed, len(sizes)):
                size = sizes[-1 - k]
                end = at + size
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                token = text[at:end]
                if out and not self.compatible(out[-1], token):
                    continue
                out.append(token)
                tried.append(k)
                at, passed = end, 0
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no merge order gives this text")
                at -= len(out.pop())
                passed = tried.pop() + 1
        return out

    def _encode_part(self, part: str) -> str:
        out: list[int] = []
        for token in self.tokens(part):
            i = self.ids.get(token)
            out += [i] if i is not None else [self.byte_ids[b] for b in token.encode()]
        return " ".join(map(str, out))

    #: Where no piece can reach over: before a mark that follows another character, and around line ends.
    _PARTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    def encode_parts(self, text: str) -> list[str]:
        """Space-separated ids of each independent part; without the end id."""
        if not text:
            return []
        return list(map(self.encoded.__getitem__, self._PARTS.findall(MARK + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.encode_parts(text) for i in part.split()] + [self.eos]

    def _spell(self, i: int) -> bytes:
        if i in self.of_byte:
            return bytes([self.of_byte[i]])
        if i == self.unknown:
            return " \u2047 ".encode()
        return b"" if i in self.silent else self.names[i].replace(MARK, " ").encode()

    def decode_text(self, ids: str) -> str:
        """Text of space-separated ids; the mark put before the text is taken off, and bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, ids.split())).removeprefix(b" ").decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_text(" ".join(map(str, ids)))


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every text (end id only, no sampling) and decode the ids again.

    Returns doc_id, n_tokens, ids_text (decimal ids joined by a space), ids_sha256,
    decoded and decoded_sha256.  A null or empty text has the end id alone.  Parts
    between spaces are encoded once and remembered in a bounded table for each worker.
    Every row gives a row, repeated ones and those without a doc_id too; no rows give
    no rows.  A very long text is encoded whole by one task; a part without spaces
    takes memory in proportion to its characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        end = str(c.eos)
        for big in batches:
            for at in range(0, len(big), 256):
                rows = big.slice(at, 256)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for text in rows.column(1).to_pylist():
                    parts = c.encode_parts(text)
                    ids = " ".join([*parts, end])
                    back = c.decode_text(ids)
                    for col, x in zip(cols, (ids.count(" ") + 1, ids, hashlib.sha256(ids.encode()).hexdigest(), back, hashlib.sha256(back.encode()).hexdigest()), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_tokens": pa.array(cols[0], pa.int64())} | {k: pa.array(v, pa.string()) for k, v in zip(("ids_text", "ids_sha256", "decoded", "decoded_sha256"), cols[1:], strict=True)})

    return keyed_texts(docs).select("doc_id", "text").mapInArrow(run, _SCHEMA)


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The digest columns of :func:`encode_pieces`."""
    return encode_pieces(docs, model_path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    """:func:`token_digests` of all ``documents`` by the default model; rows are handled as there."""
    return token_digests(read(spark, sf_dir, "documents"), default_model())
