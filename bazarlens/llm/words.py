"""Cutting whole texts at places that no tokenizer pattern reaches across, and remembering the pieces.

A single space or line feed between two non-space characters always starts a
new match of the byte-level pattern: the space belongs to what follows it, the
line feed stands alone. So a text is the sequence of its lines' words, each
word but a line's first with its space in front, and words can be encoded one
by one. A text with any other white space is cut by the pattern as a whole.
"""

from __future__ import annotations

from collections.abc import Callable


class PieceCache:
    """Results per word; ``encode`` maps new pieces to values and is asked for many at once.

    Words in front of which stands a space and words at the start of a line
    are kept apart. When ``limit`` words are held, it starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.spaced: dict[str, object] = {}
        self.first: dict[str, object] = {}
        self.feed = encode(["\n"])[0]

    @staticmethod
    def _lines(text: str) -> list[list[str]] | None:
        """The words of each line, or None if white space does not stand alone."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        return [line.split(" ") for line in text.split("\n")]

    def values(self, texts: list[str]) -> list[list]:
        """For every text the values of its pieces in order."""
        if len(self.spaced) + len(self.first) > self.limit:
            self.spaced, self.first = {}, {}
        split = [self._lines(text) if text and not (text[0].isspace() or text[-1].isspace()) else None for text in texts]
        spaced: set[str] = set()
        first: set[str] = set()
        for lines in split:
            for words in lines or ():
                first.add(words[0])
                spaced.update(words[1:])
        # A word that starts or ends with rarer white space is no safe piece.
        spaced = {w for w in spaced.difference(self.spaced)}
        first = {w for w in first.difference(self.first)}
        for words, known, lead in ((spaced, self.spaced, " "), (first, self.first, "")):
            safe = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
            known.update(dict.fromkeys(words.difference(safe)))
            known.update(zip(safe, self.encode([lead + w for w in safe]), strict=True))
        result: list[list | None] = []
        for lines in split:
            found: list | None = None if lines is None else []
            for words in lines or ():
                if found:
                    found.append(self.feed)
                found.append(self.first[words[0]])
                found.extend(map(self.spaced.__getitem__, words[1:]))
            result.append(None if found is None or None in found else found)
        rest = [i for i, found in enumerate(result) if found is None]
        for i, value in zip(rest, self.encode([texts[i] for i in rest]), strict=True):
            result[i] = [value]
        return result
