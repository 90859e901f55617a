"""What a SentencePiece model file says, and its text normalisation with source offsets."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: U+2581, which stands for a space inside pieces.
SPACE = "▁"

#: Piece kinds of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds of the model file format.
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields_of(raw: bytes):
    """(field number, value) of a protocol buffer message: int for varints, else bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """The parts of a model file that segmentation needs."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    add_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    space_as_suffix: bool = False
    raw: bytes = field(default=b"", repr=False, compare=False)

    @property
    def words_stand_alone(self) -> bool:
        """No piece has the space mark after another character, so a text may be cut before each such mark."""
        return not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED, UNUSED))


def read_model(raw: bytes) -> PieceModel:
    pieces, scores, kinds = [], [], []
    trainer: dict = {}
    rules: dict = {}
    for number, value in fields_of(raw):
        if number == 1:
            found = dict(fields_of(value))
            pieces.append(found.get(1, b"").decode())
            scores.append(struct.unpack("<f", found[2])[0] if 2 in found else 0.0)
            kinds.append(found.get(3, NORMAL))
        elif number == 2:
            trainer |= dict(fields_of(value))  # a message in several parts is their union
        elif number == 3:
            rules |= dict(fields_of(value))
    return PieceModel(
        tuple(pieces), tuple(scores), tuple(kinds), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)),
        rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)), bool(trainer.get(24, 0)), raw,
    )


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys and a table of replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.table = compiled[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key that starts at ``at``."""
        found, node = None, 0
        unit = self.units[0]
        for k in range(at, len(raw)):
            node ^= self._step(unit) ^ raw[k]
            unit = self.units[node]
            if unit & 0x800000FF != raw[k]:
                break
            if unit >> 8 & 1:
                found = self.units[node ^ self._step(unit)] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.table[found[0] : self.table.index(b"\0", found[0])], found[1]

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Longest-prefix normalisation that keeps, for each output byte, the source byte it came from."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharMap(model.char_map) if model.char_map else None
        own = sorted((p.encode() for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        self.mark = SPACE.encode() if model.escape else b" "

    def _next(self, raw: bytes, at: int) -> tuple[bytes, int]:
        if self.own and (m := self.own.match(raw, at)):
            return m[0], len(m[0])
        if self.map and (found := self.map.longest(raw, at)):
            return found
        lead = raw[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at : at + size], size

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and an array one longer: the source byte where each output byte's character starts, and at last the source's length used."""
        model, raw = self.model, text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not model.remove_extra and self.own is None and not model.space_as_suffix:
            return self._plain(raw)
        out, source, at = bytearray(), [], 0
        if model.remove_extra:
            while at < len(raw):
                piece, used = self._next(raw, at)
                if piece != b" ":
                    break
                at += used
            if at == len(raw):
                return b"", np.zeros(1, np.int64)

        def put_space(where: int) -> None:
            out.extend(self.mark)
            source.extend([where] * len(self.mark))

        if model.add_prefix and not model.space_as_suffix:
            put_space(at)
        after_space = model.remove_extra
        while at < len(raw):
            piece, used = self._next(raw, at)
            if after_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                if byte == 32 and model.escape:
                    put_space(at)
                else:
                    out.append(byte)
                    source.append(at)
            if piece:
                after_space = model.remove_extra and piece.endswith(b" ")
            at += used
        if model.remove_extra:
            while out.endswith(self.mark):
                at = source[len(out) - len(self.mark)]
                del out[-len(self.mark) :], source[-len(self.mark) :]
        if model.add_prefix and model.space_as_suffix:
            put_space(at)
        return bytes(out), np.array([*source, at], np.int64)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change, so arrays do it at once."""
        codes = np.frombuffer(raw, np.uint8)
        starts = np.arange(len(codes), dtype=np.int64)
        inside = (codes & 0xC0) == 0x80
        if inside.any():
            starts[inside] = 0
            starts = np.maximum.accumulate(starts)
        if self.mark != b" ":
            starts = np.repeat(starts, np.where(codes == 32, len(self.mark), 1))
        prefix = self.mark if self.model.add_prefix else b""
        source = np.concatenate([np.zeros(len(prefix), np.int64), starts, [len(raw)]])
        return prefix + raw.replace(b" ", self.mark), source
