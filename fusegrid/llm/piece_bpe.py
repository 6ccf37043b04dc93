"""SentencePiece BPE encoding and decoding with a prefix table.

For every prefix of a unit (a run of ``▁`` and the characters up to the next) the last token of its encoding
is unique. It is stored per prefix: automaton matches list the pieces that end there, and a piece is the last token
if the pair of it and the stored last token of the prefix before it is compatible, that is, merging the
two pieces' characters by score gives just these two back. Ids are then recovered backwards. Linear in the text.

The proof needs only that merges are chosen by score with the leftmost first, so it holds for this
model type although any two neighbours whose joined text is a piece may merge. No piece holds ``▁`` after another character
(checked on load), so units are independent; answers for short units are remembered by each worker, the older half of them going when there are too many.
The text of ids is gathered from the bytes of the pieces, for many documents at once.

Defined results: null text counts as empty and gives no ids and empty text; characters outside the vocabulary fall
back to their UTF-8 bytes; repeated rows and null ids are encoded like any other; extra columns are ignored by ``encode`` and ``encode_decode``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units up to this length are remembered; at most so many of them, and of answers for pairs, by each worker.
KEPT_CHARS, KEPT_UNITS, KEPT_PAIRS = 16, 300_000, 500_000
#: Ids whose bytes are gathered at a time.
GATHERED_IDS = 1 << 16
_ALONE = -1
_UNKNOWN = -2
_NO_MERGE = float("-inf")


@dataclass
class PieceModel:
    """What encoding needs of a model file, small enough to go with each task."""

    pieces: dict[str, tuple[int, float]]
    text_of: list[str]
    byte_ids: list[int]
    key: str = ""
    unit_memo: dict[str, bytes] = field(default_factory=dict)
    older_units: dict[str, bytes] = field(default_factory=dict)
    pairs: int = 0
    automaton: object = None
    decoding: tuple | None = None

    @staticmethod
    def load(path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {names[i]: (i, model.get_score(i)) for i in plain}
        at = {f"<0x{b:02X}>": b for b in range(256)}
        byte_ids = [0] * 256
        for i in range(n):
            if model.is_byte(i):
                byte_ids[at[names[i]]] = i
        if any(MARK in p.lstrip(MARK) for p in pieces) or not all(byte_ids):
            raise ValueError("the model must have byte fallback and no piece with ▁ inside")
        sample = "  A ﬁ\t①\n"
        if model.decode(model.encode(sample)) != sample:
            raise ValueError("the model must not normalise texts")
        text_of = [names[i].replace(MARK, " ") if names[i] in pieces else "" for i in range(n)]
        return PieceModel(pieces, text_of, byte_ids, path)

    def ready(self) -> PieceModel:
        """The copy that this worker keeps, with its automaton."""
        got = _LOADED.get(self.key)
        if got is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            #: For each piece, whether a last token before it (or none) is compatible.
            self.pair_memo = {i: {} for i, _ in self.pieces.values()}
            for p, (i, _) in self.pieces.items():
                self.automaton.add_word(p, (i, len(p) - 1, self.pair_memo[i]))
            self.automaton.make_automaton()
            self.names, self.merging = {i: p for p, (i, _) in self.pieces.items()}, {}
            got = _LOADED[self.key] = self
        return got

    def steps(self, piece: int) -> list[tuple[float, str, str]] | None:
        """Merging a piece's characters by score, leftmost first: the score of each merge with the first and the last part before it, at the end the piece. None if they do not give it back."""
        if piece in self.merging:
            return self.merging[piece]
        parts, out = list(self.names[piece]), []
        while len(parts) > 1:
            best, at = _NO_MERGE, -1
            for k in range(len(parts) - 1):
                got = self.pieces.get(parts[k] + parts[k + 1])
                if got is not None and got[1] > best:
                    best, at = got[1], k
            if at < 0:
                break
            out.append((best, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = self.merging[piece] = [*out, (_NO_MERGE, parts[0], parts[0])] if len(parts) == 1 else None
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters gives just these two back: each is merged as it is alone, as long as no merge across them comes first."""
        a, b = [] if left < 0 else self.steps(left), self.steps(right)
        if a is None or b is None:
            return False
        i = j = 0
        while a:
            (x, _, last), (y, first, _) = a[i], b[j]
            got = self.pieces.get(last + first)
            if got is not None and got[1] > x and got[1] >= y:
                return False
            if x == y == _NO_MERGE:
                return True
            i, j = (i + 1, j) if x >= y else (i, j + 1)
        return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pair_memo[right]
        got = known.get(left)
        if got is None:
            if self.pairs >= KEPT_PAIRS:
                self.pairs = 0
                for held in self.pair_memo.values():
                    held.clear()
            self.pairs += 1
            got = known[left] = self.stays(left, right)
        return got

    def unit_ids(self, unit: str) -> list[int]:
        n, done = len(unit), -1
        last, size = [_UNKNOWN] * (n + 1), [1] * (n + 1)
        last[0] = _ALONE
        for at, (piece, less, known) in self.automaton.iter(unit):
            if at == done:
                continue  # its last token is known, and there is but one
            before = last[at - less]
            ok = known.get(before)
            if ok or (ok is None and self.compatible(before, piece)):
                last[at + 1], size[at + 1], done = piece, less + 1, at
        out, at = [], n
        while at > 0:
            if last[at] == _UNKNOWN:
                out += [self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
            else:
                out.append(last[at])
            at -= size[at]
        return out[::-1]

    def unit(self, rest: str) -> bytes:
        """Ids as int32 bytes, of ▁ and the rest of a unit."""
        got = self.older_units.get(rest)
        if got is None:
            got = array("i", self.unit_ids(MARK + rest)).tobytes()
        if len(rest) <= KEPT_CHARS:
            if len(self.unit_memo) >= KEPT_UNITS // 2:
                self.older_units = dict(self.unit_memo)
                self.unit_memo.clear()
            self.unit_memo[rest] = got
        return got

    def decode_pieces(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        byte_of = {i: b for b, i in enumerate(self.byte_ids)} if not hasattr(self, "byte_of") else self.byte_of
        self.byte_of = byte_of
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one space at the start, put there by encoding, goes."""
        text = self.decode_pieces(ids)
        return text[1:] if ids and self.text_of[ids[0]].startswith(" ") else text

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that ids decode to, one id after the other; where each begins, and how many there are. Byte pieces stand for themselves."""
        if self.decoding is None:
            byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            parts = [byte_of.get(i, t.encode()) for i, t in enumerate(self.text_of)]
            sizes = np.array([len(p) for p in parts], np.int64)
            self.decoding = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self.decoding

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each document's ids, as encoding made them (so byte pieces come as whole characters); ``ends``: where documents end, from 0.

        The space that encoding put at the start goes.
        """
        data, begins, sizes = self.piece_bytes()
        parts = []
        for at in range(0, len(ids), GATHERED_IDS):
            some = ids[at : at + GATHERED_IDS]
            long = sizes[some]
            after = np.cumsum(long)
            parts.append(data[np.repeat(begins[some] - (after - long), long) + np.arange(after[-1])].tobytes())
        flat = b"".join(parts)
        cut = np.concatenate([[0], np.cumsum(sizes[ids])])[ends].tolist()
        return [flat[a + 1 : b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_text(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        if not text:
            return b""
        marked = text.replace(" ", MARK)
        rests = marked.split(MARK)
        if "" in rests:  # runs of ▁: a unit takes the whole run
            rests = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)]
        memo, unit = self.unit_memo, self.unit
        return b"".join([memo.get(r) or unit(r) for r in rests])


_LOADED: dict[str, PieceModel] = {}


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string (the text that the ids give back)."""
    model = PieceModel.load(model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = model.ready()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows = [own.encode_text(t or "") for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
                flat = np.frombuffer(b"".join(rows), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                decoded = pa.array(own.decode_many(flat, ends), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
