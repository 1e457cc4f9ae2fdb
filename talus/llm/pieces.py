"""The vocabulary of a sentencepiece model as plain tables, and its rules for white space."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

#: The character that stands for a space inside pieces.
MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    text: list[str]
    score: list[float]
    #: Ids of pieces that spell themselves, by their text.
    normal: dict[str, int] = field(repr=False)
    #: Ids of the 256 byte pieces, or an empty list.
    byte_ids: list[int] = field(repr=False)
    unknown: int
    #: The scores are log probabilities.
    unigram: bool


@functools.cache
def load(path: str) -> Pieces:
    """Read a model file. Models that rewrite characters, drop white space, put no space in front,
    hold spaces inside pieces or define user symbols split texts differently and are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
    normal, spelled, unknown = {}, {}, 0
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.NORMAL:
            normal[p.piece] = i
        elif p.type == kinds.BYTE:
            spelled[int(p.piece[1:-1], 16)] = i
        elif p.type == kinds.UNKNOWN:
            unknown = i
        elif p.type != kinds.CONTROL:
            raise ValueError(f"piece {p.piece!r}: user-defined and unused pieces are not supported")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that keep characters and white space, and put a space in front")
    if any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError("pieces with a space after another character are not supported")
    if proto.trainer_spec.byte_fallback and len(spelled) != 256:
        raise ValueError("byte fallback needs all 256 byte pieces")
    bytes_ = [spelled[b] for b in range(256)] if proto.trainer_spec.byte_fallback else []
    return Pieces([p.piece for p in proto.pieces], [p.score for p in proto.pieces], normal, bytes_, unknown, proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM)


_BEFORE_SPACES = re.compile("(?<=[^ ])(?=[ ])")


def chunks(text: str) -> list[str]:
    """Parts of a text that no piece reaches across: it is cut before every run of spaces. The space
    that each part begins with (for the first, the one the model puts in front) is left out."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [c[1:] for c in _BEFORE_SPACES.split(" " + text)]


def marked(chunk: str) -> str:
    """A chunk as the pieces spell it."""
    return MARK + chunk.replace(" ", MARK)
