"""The pieces of a SentencePiece model file, and how its texts fall apart into chunks.

Space and U+2581 are one character, written as the latter inside pieces; every text gets one in front. No piece has
it after another character, so a text can be cut before each run of it (a model for which that does not hold is
refused); tabs and line breaks that no piece contains stand alone. Equal chunks are encoded once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass
class Pieces:
    """Normal pieces with id and score (spaces as U+2581), ids of the 256 byte pieces, and the number of ids.

    breaks: tabs and line breaks that no piece contains.
    """

    names: list[str]
    ids: list[int]
    scores: list[float]
    bytes_: list[int]
    size: int
    lowest: float
    breaks: str


def load(path: str = MODEL) -> Pieces:
    """Read on the driver; what goes to the tasks is this small table."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    normal = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    names = [model.id_to_piece(i) for i in normal]
    odd = [n for n in names if re.search(f"[^{SPACE}]{SPACE}| ", n)]
    if odd:
        raise ValueError(f"pieces across chunks: {odd[:3]}")
    return Pieces(names, normal, [model.get_score(i) for i in normal], [i for i in every if model.is_byte(i)], len(every), min(model.get_score(i) for i in every), "".join(c for c in "\t\n\v\f\r" if not any(c in n for n in names)))


def chunker(breaks: str):
    """A function that cuts a text into its chunks, spaces not yet escaped; an empty text has none."""
    find = re.compile(f" +[^ {breaks}]*|[^ {breaks}]+" + (f"|[{breaks}]" if breaks else "")).findall
    return lambda text: find(" " + text.replace(SPACE, " ")) if text else []
