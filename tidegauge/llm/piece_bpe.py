"""SentencePiece BPE encoding and decoding, exact, by backtracking over longest matches.

The text is cut where no piece can span (before a run of word marks), and each part is encoded by itself: an
Aho-Corasick automaton finds all pieces at every position, the longest is tried first, a piece is taken only if the
pair it forms with its left neighbour is what merging the pair's text again gives, and a bitfield keeps the positions
from which no compatible rest exists. A part's encoding is the only sequence whose neighbours are all compatible, so
this equals the library's merge loop.

Null and empty texts have no tokens. Characters without a piece become their UTF-8 bytes' pieces, or the unknown id
in models without such pieces. Repeated rows and ties need no rule: each row is encoded by itself. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries a Python worker keeps of what it has encoded before; beyond, it starts anew.
MEMO_PARTS, MEMO_PAIRS, MEMO_LENGTH = 300_000, 500_000, 48


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """A BPE model file's pieces and the encoder over them."""

    def __init__(self, blob: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix, trainer = True, {}
        for number, value in _fields(blob):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                n = dict(_fields(value))
                if n.get(2) or n.get(4, 1):
                    raise ValueError("only models without character maps and white-space removal are supported")
                self.prefix = bool(n.get(3, 1))
        if trainer.get(3, 1) != 2 or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.scores = scores
        self.unknown = self.kinds.index(UNKNOWN)
        bytes_ = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [i]:  # others never come out of merging
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        #: The next shorter piece that begins a piece, to be tried after it.
        self.shorter = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), -1)
        inner = [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else re.compile(r"(?s).+")
        self.names = [str(i) for i in range(len(self.pieces))]
        #: How an id reads; a byte above 127 as the surrogate that stands for it in "surrogateescape".
        self.surface = [
            p.replace(MARK, " ") if k == NORMAL else self._byte(int(p[3:5], 16)) if k == BYTE else trainer[44].decode() if k == UNKNOWN and 44 in trainer else " ⁇ " if k == UNKNOWN else ""
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _byte(b: int) -> str:
        return chr(b) if b < 128 else chr(0xDC00 + b)

    def merged(self, text: str) -> list[int]:
        """Ids that merging gives: best score first, leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                return [ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two neighbours again gives the two."""
        key = a * len(self.pieces) + b
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return fits

    def backtrack(self, text: str) -> list[int]:
        longest = [-1] * (len(text) + 1)
        for end, (length, i) in self.automaton.iter(text):
            longest[end - length + 1] = i  # longer ones come later
        lengths, shorter, pairs, size = self.lengths, self.shorter, self.pairs, len(self.pieces)
        n, failed, pos, last = len(text), None, 0, -1
        ids: list[int] = []
        i = longest[0]
        while pos < n:
            while i >= 0:
                end = pos + lengths[i]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last * size + i)
                    if fits if fits is not None else self.compatible(last, i):
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                pos, last = end, i
                i = longest[end]
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                i = ids.pop()
                pos -= lengths[i]
                last = ids[-1] if ids else -1
                i = shorter[i]
        return ids

    def encode_part(self, part: str) -> tuple[int, ...]:
        if self.chars.issuperset(part):
            ids = tuple(self.backtrack(part))
        else:
            out: list[int] = []
            run = 0
            for i, c in enumerate(part):
                if c not in self.chars:
                    if i > run:
                        out += self.backtrack(part[run:i])
                    out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                    run = i + 1
            if run < len(part):
                out += self.backtrack(part[run:])
            ids = tuple(out)
        if len(part) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_PARTS:
                self.memo.clear()
            self.memo[part] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        known, encode_part = self.memo.get, self.encode_part
        return list(chain.from_iterable([known(p) or encode_part(p) for p in self.parts.findall(MARK + marked if self.prefix else marked)]))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character become U+FFFD, one each."""
        if not ids:
            return b""
        text = "".join(map(self.surface.__getitem__, ids))
        if self.prefix and text.startswith(" ") and next((self.kinds[i] for i in ids if self.kinds[i] != CONTROL), None) == NORMAL:
            text = text[1:]
        try:
            return text.encode()
        except UnicodeEncodeError:
            raw = text.encode("utf-8", "surrogateescape")
        while True:
            try:
                raw.decode()
                return raw
            except UnicodeDecodeError as e:
                raw = raw[: e.start] + "�".encode() + raw[e.start + 1 :]


_MODELS: dict[bytes, PieceModel] = {}


def model_of(blob: bytes) -> PieceModel:
    """One model in a worker process, with what it has learnt of earlier texts."""
    key = hashlib.sha256(blob).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(blob)
    return _MODELS[key]


def _blob(df: DataFrame, model_path: str):
    """The model file's bytes for all tasks; the file is read by the driver and at most 64 MB."""
    with open(model_path, "rb") as f:
        blob = f.read(64_000_001)
    if len(blob) > 64_000_000:
        raise ValueError("the model file is over 64 MB")
    return df.sparkSession.sparkContext.broadcast(blob)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>) of every row."""
    blob = _blob(docs, model_path)

    def run(batches):
        m = model_of(blob.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((m.encode(t.as_py()) for t in b.column(1)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids."""
    blob = _blob(encoded, model_path)

    def run(batches):
        m = model_of(blob.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((m.decode_bytes(t.as_py() or []).decode() for t in b.column(1)), pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass, so that ids and texts stay in the task: (doc_id, n_tokens,
    ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded UTF-8)."""
    blob = _blob(docs, model_path)

    def run(batches):
        m = model_of(blob.value)
        for b in batches:
            counts, digests, decoded = [], [], []
            for t in b.column(1):
                ids = m.encode(t.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(m.names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(m.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
