"""Token ids of whole texts, inside Spark tasks.

A text is cut at single spaces between visible characters.  Neither supported pre-tokenizer ever joins characters
across such a space, so ids of the pieces, joined, are the ids of the text; pieces repeat, so most come from a cache
and the tokenizers library encodes each new one once.  Words are encoded many at a time only if they are of letters that
no normalizer takes apart or joins (ASCII and the Latin blocks after it); every other piece goes to the library alone.
Tests compare this with the library on whole texts, over all code points below U+3000 and the compatibility blocks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space for Python, but not for the vocabularies.
_RARE = re.compile(r"[\x1c-\x1f]")
_TAIL = ".,;:!?*#%$&"
#: Latin letters, each of which stays one letter when normalized; U+0130 becomes two characters in lower case.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_ENCODERS: dict[tuple[str, int], Encoder] = {}
#: Pieces that a worker remembers (twice as many for a while, about 220 MB), and where memory is short (30 MB): well over the time.
CACHE, SMALL = 600_000, 60_000
#: Characters of texts whose new pieces are encoded together.
SLICE = 300_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts in slices: a slice's new pieces are encoded together, all others come from the cache."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.first, self.last = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.first[i], self.last[i] = token.startswith("\u0120"), token.endswith("</w>")
        self.ends = bool(self.last.any())  # words end in a mark, else they begin with a space
        self.limit, self.slice_chars = cache, SLICE
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.newline = self.whole("\n")
        self.line = int(np.frombuffer(self.newline, "<u4")[0]) if self.newline else -1

    def whole(self, text: str) -> bytes:
        got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(got, dtype="<u4").tobytes()

    def words(self, heads: list[str], bare: bool) -> list[bytes]:
        """Ids of words of letters only, each after a space or, bare, after a line break."""
        if not heads:
            return []
        gap = "\n" if bare else " "
        ids = np.frombuffer(self.whole(gap + gap.join(heads)), "<u4")
        if self.ends:
            starts, stops = np.append(0, np.flatnonzero(self.last[ids]) + 1), np.flatnonzero(self.last[ids]) + 1
        elif bare:
            starts = np.flatnonzero(ids == self.line) + 1
            stops = np.append(starts[1:] - 1, len(ids))
        else:
            starts = np.flatnonzero(self.first[ids])
            stops = np.append(starts[1:], len(ids))
        if len(stops) != len(heads):
            return [self.whole(h if bare else " " + h) for h in heads]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip((starts * 4).tolist(), (stops * 4).tolist())]

    def learn(self, fresh: Iterable[str]) -> None:
        """Adds pieces to the cache; a key that begins with a line break is that and what follows it."""
        pieces, older, plain, bare, tailed, lines = self.pieces, self.older, set(), set(), [], []

        def word(key: str) -> None:
            text = key[1:] if key[:1] == "\n" else key
            head = text.rstrip(_TAIL)
            if not _LETTERS.fullmatch(head):
                pieces[key] = self.newline + self.whole(text) if key[:1] == "\n" else self.whole(" " + text)
                return
            whole = key[: len(key) - len(text) + len(head)]
            if whole not in pieces and (ready := older.get(whole)) is not None:
                pieces[whole] = ready
            elif whole not in pieces:
                (bare if key[:1] == "\n" else plain).add(whole)
            if len(head) < len(text):
                tailed.append((key, whole, text[len(head) :]))

        for piece in fresh:
            if (known := older.get(piece)) is not None:
                pieces[piece] = known
            elif "\n" in piece[1:] and all(x.split() == [x] for x in piece.split("\n")):
                keys = [x if i == 0 else "\n" + x for i, x in enumerate(piece.split("\n"))]
                lines.append((piece, keys))
                for key in keys:
                    if key not in pieces:
                        word(key)
            else:
                word(piece)
        for group, is_bare in ((list(plain), False), (list(bare), True)):
            for i in range(0, len(group), 2000):
                part = group[i : i + 2000]
                pieces.update(zip(part, [self.newline + x for x in self.words([x[1:] for x in part], True)] if is_bare else self.words(part, False)))
        for key, head, tail in tailed:
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            pieces[key] = pieces[head] + self.tails[tail]
        for piece, keys in lines:
            pieces[piece] = b"".join([pieces[k] for k in keys])

    def parts(self, text: str) -> list[str]:
        """The text's pieces; but for vocabularies that drop white space, the first follows nothing."""
        words = text.split()
        if self.ends and not self.newline:
            return words if not _RARE.search(text) else [text]
        gaps = text.count(" ") + text.count("\n")
        plain = len(words) == gaps + 1 and sum(map(len, words)) + gaps == len(text)  # single gaps of these two kinds alone
        return text.replace("\n", " \n").split(" ") if plain else _CUT.split(text)

    def slice(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            self.older, self.pieces, self.tails = self.pieces, {}, {}
        known, parts = self.pieces, list(map(self.parts, texts))
        firsts = [] if self.ends else [p.pop(0) for p in parts]
        flat = list(chain.from_iterable(parts))
        found = list(map(known.get, flat))
        missing = [i for i, ids in enumerate(found) if ids is None]
        self.learn({flat[i] for i in missing})
        for i in missing:
            found[i] = known[flat[i]]
        at = [0, *accumulate(map(len, parts))]
        rest = [b"".join(found[i:j]) for i, j in zip(at, at[1:])]
        if self.ends:
            return rest
        begun = self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)
        return [np.asarray(first.ids, dtype="<u4").tobytes() + ids for first, ids in zip(begun, rest)]

    def batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; null is empty."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= self.slice_chars:
                yield from self.slice(held)
                held, size = [], 0
        yield from self.slice(held)


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The encoder of this Python worker."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]
