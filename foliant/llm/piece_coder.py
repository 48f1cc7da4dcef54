"""SentencePiece merge-type encoding by backtracking, and decoding.

The merges are never replayed over a text. An Aho-Corasick automaton over the vocabulary finds all
pieces that start at each place; the longest is tried first. A piece may follow another only if
merging their joined text anew gives exactly these two pieces. If no piece fits at a place, that
place is marked as failed in a bitfield and the last piece gives way to the next shorter one. The
only sequence whose neighbours are all compatible is the one that the merges would have made.

Encoding is per document and needs no shuffle. Words repeat, so a memo bounded in bytes keeps the
ids of what stands between two spaces for the time of a task: no piece holds a space mark after
another character, so nothing merges across such a border.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes of each of the two generations of the memo, and pairs of pieces that are remembered.
MEMO_BYTES, PAIRS = 32 << 20, 250_000
#: About what an entry takes besides its word's bytes and its ids.
_ENTRY = 200


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbered fields of one message of the model file."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _one_mark(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("foliant_one_mark", _one_mark)


class PieceCoder:
    """Vocabulary with its automaton. Built once per Python worker from the model's bytes."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        spec = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec |= dict(_fields(value))
        if spec[2] or spec[4] or not spec[5] or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models with identity normalisation and plain pieces are supported")
        self.prefix = bool(spec[3])
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.trie = ahocorasick.Automaton()
        for p in self.ids:
            self.trie.add_word(p, p)
        self.trie.make_automaton()
        # A line break outside the vocabulary parts words just as a space does.
        stop = "".join(c for c in "\n\r\t" if c not in self.characters)
        self.words = re.compile(f"[{stop}]|{MARK}*[^{MARK}{stop}]+|{MARK}+" if stop else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()
        self.surface = [
            chr(b) if (b := int(p[3:5], 16)) < 128 else chr(0xDC00 + b) if k == BYTE else p
            for p, k in ((p if k == BYTE else "<0x80>", k) for p, k in zip(self.pieces, self.kinds))
        ]
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k != BYTE:
                self.surface[i] = {CONTROL: "", UNKNOWN: " ⁇ "}.get(k, p)

    def forget(self) -> None:
        """Give back what was remembered of the words met so far."""
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.fits.clear()

    def merged(self, text: str) -> list[str]:
        """Replay the merges over a short text: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text anew keeps exactly this border ("" at the start)."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()  # the same dictionary, as backtrack() holds it
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.fits[left, right] = known
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        starts: list[list[str]] = [[] for _ in text]
        for end, piece in self.trie.iter(text):
            starts[end + 1 - len(piece)].append(piece)  # shortest first, as ends ascend
        length, fits = len(text), self.fits
        failed, clean = bytearray(length // 8 + 1), True
        chosen: list[tuple[str, int]] = []
        at, rank, last = 0, len(starts[0]) - 1, ""
        while at < length:
            here = starts[at]
            while rank >= 0:
                piece = here[rank]
                end = at + len(piece)
                if clean or not failed[end >> 3] >> (end & 7) & 1:
                    fit = fits.get((last, piece))
                    if fit or fit is None and self.compatible(last, piece):
                        break
                rank -= 1
            if rank >= 0:
                chosen.append((piece, rank))
                at, last = end, piece
                rank = len(starts[at]) - 1 if at < length else -1
            else:
                clean = False
                failed[at >> 3] |= 1 << (at & 7)
                piece, rank = chosen.pop()
                at -= len(piece)
                last = chosen[-1][0] if chosen else ""
                rank -= 1
        return [piece for piece, _ in chosen]

    def word(self, text: str) -> list[int]:
        """Ids of a stretch; characters outside the vocabulary become byte pieces."""
        if self.characters.issuperset(text):
            return [self.ids[p] for p in self.backtrack(text)]
        out: list[int] = []
        run: list[str] = []
        for c in [*text, ""]:
            if c in self.characters:
                run.append(c)
                continue
            if run:
                out += [self.ids[p] for p in self.backtrack("".join(run))]
                run = []
            own = [self.bytes[b] for b in c.encode("utf-8", "replace")]
            out += own if min(own, default=0) >= 0 else [self.unknown]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers. A word whose entry alone exceeds a generation is not remembered."""
        if not text:
            return b""
        words = self.words.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        memo, large = self.memo, {}
        for w in set(words).difference(memo):
            if (ids := self.older.get(w)) is None:
                ids = array("i", self.word(w)).tobytes()
            size = _ENTRY + 2 * len(w) + len(ids)
            if size > MEMO_BYTES // 64:
                large[w] = ids
            else:
                memo[w] = ids
                self.held += size
        # The words of one text stay at hand until it is done; a very long text has as many of its own.
        out = b"".join([large[w] if w in large else memo[w] for w in words] if large else map(memo.__getitem__, words))
        if self.held >= MEMO_BYTES:
            self.memo, self.older, self.held = {}, memo if self.held < 2 * MEMO_BYTES else {}, 0
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if self.prefix and ids and self.kinds[ids[0]] == NORMAL:
            text = text.removeprefix(MARK)
        text = text.replace(MARK, " ")
        if not text.isascii() and any("\udc80" <= c <= "\udcff" for c in set(text)):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "foliant_one_mark")
        return text


_CODERS: dict[int, PieceCoder] = {}


def coder(model: bytes) -> PieceCoder:
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file; without a path, that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and its ids decoded again.

    Null and empty texts give no ids and an empty decoded text. Very long texts are encoded word by
    word, so memory follows the text. Repeated rows give repeated results; an empty table gives none.
    Further columns are ignored. The model (half a megabyte) travels with the task.
    """
    data = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(data)
        own.forget()  # a task that was stopped may have left its words
        for batch in batches:
            # A long text is as many ids as it needs; short ones come some hundreds at a time.
            for at, texts in shared.texts_of(batch, 1):
                ids = [np.frombuffer(own.encode(t), "<i4") for t in texts]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                offsets = pa.array(np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)])
                decoded = pa.array([own.decode(x.tolist()) for x in ids], pa.string())
                flat = pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, flat), decoded], ["doc_id", "ids", "decoded"])
        own.forget()  # the worker may serve other tasks next

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: decode a column ``ids`` of token ids; null ids count as none."""
    data = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(data)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(shared.tidy(run), "doc_id long, text string")


def op4_sentencepiece_backtracking(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(shared.table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
