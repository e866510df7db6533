"""Read a SentencePiece model file and rebuild it in the tokenizers library.

The protobuf wire format is read directly (no generated classes). Field
numbers of ModelProto, SentencePiece, TrainerSpec and NormalizerSpec are those
of the public sentencepiece_model.proto.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"

# Fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 2:
            size = varint()
            yield number, data[at: at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")


@dataclass
class PieceModel:
    """Pieces with scores and types, and the settings that encoding needs."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def read(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.scores.append(piece.get(2, 0.0))
                out.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(wire_fields(value))
                out.kind = spec.get(3, UNIGRAM)
                out.byte_fallback = bool(spec.get(35, 0))
                out.unk_id = spec.get(40, 0)
            elif number == 3:
                spec = dict(wire_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix = bool(spec.get(3, 1))
                out.squeeze_spaces = bool(spec.get(4, 1))
                out.escape_spaces = bool(spec.get(5, 1))
        return out

    def splits_at_marks(self) -> bool:
        """No piece has a mark after another character: then no merge or piece
        crosses the start of a marked word, and words encode on their own."""
        return not any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED))

    def normalizer(self) -> normalizers.Normalizer:
        steps: list[normalizers.Normalizer] = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def merges(self) -> list[tuple[str, str]]:
        """BPE merges in the order that the piece scores imply."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED)}
        found = []
        for piece, i in ids.items():
            parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            found += [(-self.scores[i], ids[a], ids[b], a, b) for a, b in parts]
        return [(a, b) for *_, a, b in sorted(found, key=lambda m: m[:3])]

    def tokenizer(self) -> Tokenizer:
        unk = self.pieces[self.unk_id]
        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores)), self.unk_id, self.byte_fallback)
        elif self.kind == BPE:
            vocabulary = {p: i for i, p in enumerate(self.pieces)}
            model = models.BPE(vocab=vocabulary, merges=self.merges(), unk_token=unk, fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        out = Tokenizer(model)
        out.normalizer = self.normalizer()
        if self.splits_at_marks():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id decodes to; control pieces to nothing."""
        out = []
        for piece, kind in zip(self.pieces, self.types):
            if kind == BYTE:
                out.append(bytes([int(piece[3:-1], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out
