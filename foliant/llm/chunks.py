"""Ids of texts by remembered chunks between single spaces and line ends.

A byte-level cut never lets a match go on past a space or line end that stands between two
characters that are no white space: the match before ends there and the next begins there. So a text
may be cut at these places, and each distinct chunk encoded once. A text in which a space or line end
stands next to white space is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable


#: Patterns of which the above is known (a fixed value).
CUT_AT_SPACES = frozenset({r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""})


#: Stands for the ids of a chunk at whose edges the text may not be cut; bytes cannot be joined with it.
ODD = "odd"


class Chunks:
    """Remembers chunk -> bytes of its ids, or ODD.

    A chunk that begins with a line end stands for itself, any other for itself behind a space.
    `encode` gives the ids of each string of a list, and `encode_words` those of strings that hold no
    line end and no white space at their ends but for one space at the start. At most `limit` chunks
    are remembered, none over `longest` characters.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[bytes]],
        limit: int,
        longest: int = 64,
        encode_words: Callable[[list[str]], list[bytes]] | None = None,
    ):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.encode_words = encode_words or encode
        self.known: dict[str, bytes | str] = {}
        self.before: dict[str, bytes | str] = {}

    def _learnt(self, new: set[str]) -> dict[str, bytes | str]:
        """A table with the new chunks; remembers those that are not too long."""
        if len(self.known) + len(new) > self.limit // 2:  # what has been in use of late outlives this
            self.known, self.before = {}, self.known
        made: dict[str, bytes | str] = {}
        known, before = self.known.get, self.before.get
        # A stop or comma behind a letter is a match of its own, so the word before it may be known.
        line_end, *ends = self.encode(["\n", ".", ","])
        stops = dict(zip(".,", ends, strict=True))
        words, begun, long = [], [], []
        for c in new:
            if (ids := before(c)) is not None:
                made[c] = ids
                continue
            if len(c) > self.longest:
                long.append(c)
            if not c or c[-1].isspace() or (c[1] if c[0] == "\n" else c[0]).isspace():
                made[c] = ODD
            elif c[-1] in stops and c[-2:-1].isalpha() and (word := known(c[:-1])) is not None and word is not ODD:
                made[c] = word + stops[c[-1]]
            elif c[0] == "\n":
                begun.append(c)
            else:
                words.append(c)
        ids = self.encode_words([" " + c for c in words] + [c[1:] for c in begun])
        made.update(zip(words, ids))  # noqa: B905  the rest is of the chunks that begin with a line end
        made.update((c, line_end + x) for c, x in zip(begun, ids[len(words) :], strict=True))
        self.known.update(made)
        for c in long:
            del self.known[c]
        return made

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of the whole texts, as `encode` would give them."""
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        begun = self.encode([c.pop(0) for c in cut])
        get = self.known.get
        found = [list(map(get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = set()
        for c, gap in zip(cut, gaps, strict=True):
            new.update(map(c.__getitem__, gap))
        if len(new) > self.limit // 2:  # more at once than may be remembered
            return self.encode(texts) if len(texts) == 1 else [x for t in texts for x in self.ids([t])]
        if new:
            table = self._learnt(new)
            for c, f, gap in zip(cut, found, gaps, strict=True):
                for i in gap:
                    f[i] = table[c[i]]
        out: list[bytes | None] = []
        for head, f in zip(begun, found, strict=True):
            try:
                out.append(head + b"".join(f))
            except TypeError:  # an ODD one
                out.append(None)
        odd = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(odd, self.encode([texts[k] for k in odd]), strict=True):
            out[k] = x
        return out
