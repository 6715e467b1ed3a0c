"""A SentencePiece model's pieces, and how texts part into independent segments."""

from __future__ import annotations

import re

SPACE = "▁"


class Pieces:
    """Pieces and scores of a model with byte fallback, a dummy space before the text
    and no normalisation.

    A segment is a run of spaces with the text up to the next space, or a line end.
    No piece reaches over a segment's end: none has a space after another
    character, and none holds a line end (both are checked here), so whatever is
    best for a text is best for each of its segments."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, name in enumerate(names):
            if lib.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[name], self.scores[name] = i, lib.get_score(i)
        #: every piece's score; None for what only starts a longer piece
        self.heads: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.scores
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this model reaches over the end of a segment")
        #: what each id stands for
        self.text = [b""] * n
        for p, i in self.ids.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])

    def round_scores(self, unit: int) -> None:
        """Rounds the scores to multiples of 1 / unit."""
        for some in (self.scores, self.heads):
            some.update((p, round(x * unit) / unit) for p, x in some.items() if x is not None and abs(x) < 1e8)

    def segments(self, text: str) -> list[str]:
        """Keys of a text's segments, in order; parts() tells what a key stands for.

        The usual text, whose spaces are single and inside its lines, is cut by one
        split: its keys are words without their leading space, or a line end with
        the word after it.  Keys of other texts start with the spaces themselves, or
        with a line end."""
        if not text:
            return []
        if "  " in text or " \n" in text or text[-1] == " " or text[0] == " " or SPACE in text:
            return [k for line in re.split("(\n)", SPACE + text.replace(" ", SPACE)) for k in _keys(line)]
        return text.replace("\n", " \n").split(" ")


def _keys(line: str) -> list[str]:
    if line == "\n":
        return ["\n"]
    keys = re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", line)
    # a word at the start of a line has no space of its own
    return [" " + keys[0], *keys[1:]] if keys and keys[0][0] != SPACE else keys


def parts(key: str) -> tuple[int, str]:
    """(line ends, the characters after them) that a key of segments() stands for."""
    first = key[:1]
    if first == "\n":
        return 1, key[1:]
    if first == SPACE:
        return 0, key
    if first == " ":
        return 0, key[1:]
    return 0, SPACE + key
