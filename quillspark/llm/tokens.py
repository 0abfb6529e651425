"""Token ids of whole texts by a public tokenizer, with a bounded memory of words.

The pre-tokenizers of both vocabularies never join what stands before and after
a single space between two characters that aren't white space: such a text's
ids are the ids of its pieces in turn, each piece but the first with its space
in front. A piece is encoded once per worker and remembered. A text where any
other white space stands next to a space, or a space at an end, is encoded whole.
One or two line feeds are tokens of their own where text follows, so a text
without longer runs of them, and with none next to a space, is cut there too.
A vocabulary that drops white space is cut at all of its ASCII kind.
Pieces are kept as UTF-8; for a vocabulary of lower case A-Z are lowered first.

Ids are those of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`
with nothing else set: the library makes a special token's string in a text
(`<|endoftext|>`) its one special id. A text with `<|` is therefore encoded whole.
Pieces of Latin letters alone are one pre-token: they go to the library's model
directly, in the byte alphabet of its pre-tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain, pairwise
from operator import attrgetter

import numpy as np

from .common import ASCII_LOWER

#: Pieces that a worker remembers at most, in two generations: the older one is dropped as the newer fills.
MEMORY_PIECES = 600_000
#: Pieces that the tokenizer gets at a time: its own results are far larger than their ids.
PIECES_AT_ONCE = 10_000
#: Bytes beyond which a piece isn't remembered.
MEMORY_PIECE_BYTES = 28

#: The special token that both vocabularies have; the library cuts at it before all else.
END_MARK = "<|endoftext|>"
#: What every special token starts with.
MARK_START = b"<|"

# Latin letters and then ASCII punctuation, if any: both pre-tokenizers cut between the two.
_WORD_AND_MARKS = re.compile(rb"((?:[A-Za-z]++|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])++)([!-&(-/:-@\[-`{-~]*+)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_ID = attrgetter("id")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _touches_space(piece: bytes) -> bool:
    """Whether nothing is left without the leading space, or white space stands at an end."""
    if piece in (b"", b"\n"):
        return False
    bare = piece[1:] if piece[:1] == b" " else piece
    if not bare or bare[0] <= 32 or bare[-1] <= 32:
        return True
    if bare[0] < 128 and bare[-1] < 128:
        return False
    text = bare.decode()
    return text[0].isspace() or text[-1].isspace()


class Encoder:
    """encode(texts) gives one uint16 array for each text. keep_space: spaces are part of the vocabulary's tokens."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_mark = self.tokenizer.token_to_id(END_MARK)
        self.keep_space = keep_space
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Each text's ids by the library as it is."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in (e.ids for e in found)]

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces without special marks, joined by the end mark, which the library cuts at."""
        out: list[bytes] = []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            part = [x.decode() for x in pieces[at : at + PIECES_AT_ONCE]]
            ids = np.array(self.tokenizer.encode_batch_fast([END_MARK.join(part)], add_special_tokens=False)[0].ids, np.uint16)
            edges = [-1, *np.flatnonzero(ids == self.end_mark).tolist(), len(ids)]
            raw = ids.tobytes()
            out += [raw[2 * a + 2 : 2 * b] for a, b in pairwise(edges)]
        return out

    def _words(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of Latin letters, with the space before them, if any."""
        if not pieces:
            return []
        text = b"\n".join(pieces)
        if text.isascii():
            letters = text.decode().replace(" ", _BYTE_LETTERS[0x20]).split("\n")
        else:
            whole = text if self.keep_space else text.decode().lower().encode()
            letters = whole.decode("latin-1").translate(_BYTE_LETTERS).split(_BYTE_LETTERS[0x0A])
        found = [list(map(_ID, self.model.tokenize(x))) for x in letters]
        raw = np.fromiter(chain.from_iterable(found), np.uint16).tobytes()
        edges = np.cumsum([0, *map(len, found)]) * 2
        return [raw[a:b] for a, b in pairwise(edges.tolist())]

    def _learn(self, new: set[bytes]) -> set[bytes]:
        """Brings these pieces into the younger memory; letters and marks are looked up apart.

        Gives those that touch white space: they aren't learned.
        """
        old, young = self.old, self.young
        known = new & old.keys()
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        plain, wide, others, cut, odd = [], [], [], [], set()
        for x in new - known if known else new:
            m = _WORD_AND_MARKS.fullmatch(x, x[:1] == b" ")
            if m:
                end = m.end(1)
                if end < len(x):
                    cut.append((x, x[:end], x[end:]))
                else:
                    (plain if x.isascii() else wide).append(x)
            elif self.keep_space and _touches_space(x):
                odd.add(x)
            else:
                others.append(x)
        more = {y for _, *xy in cut for y in xy}.difference(young, plain, wide, others)
        again = more & old.keys()
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        for y in more - again:
            (others if not _WORD_AND_MARKS.fullmatch(y, y[:1] == b" ") else plain if y.isascii() else wide).append(y)
        young.update(zip(plain, self._words(plain), strict=True))
        young.update(zip(wide, self._words(wide), strict=True))
        young.update(zip(others, self._joined(others), strict=True))
        young.update((x, young[a] + young[b]) for x, a, b in cut)
        self.long += [x for x in chain(plain, wide, others, (x for x, _, _ in cut)) if len(x) > MEMORY_PIECE_BYTES]
        return odd

    def _split(self, data: bytes) -> list[bytes]:
        if not self.keep_space:
            return data.translate(ASCII_LOWER).split()
        if b"\x1e" in data:
            return [b" " * (i > 0) + w for i, w in enumerate(data.split(b" "))]
        if b"\n" in data and not (b"\n\n\n" in data or b"\n " in data or b" \n" in data or data.endswith(b"\n\n")):
            data = data.replace(b"\n", b"\x1e\n\x1e")
        return data.replace(b" ", b"\x1e ").split(b"\x1e")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > MEMORY_PIECES // 2:
            self.old, self.young = self.young, {}
        young = self.young
        raw = [text.encode() for text in texts]
        marked = [MARK_START in data for data in raw]
        split = [[] if m else self._split(data) for data, m in zip(raw, marked, strict=True)]
        odd = self._learn(set().union(*split).difference(young))
        apart = [m or not odd.isdisjoint(words) for m, words in zip(marked, split, strict=True)] if odd else marked
        whole = iter(self._whole([t for t, x in zip(texts, apart, strict=True) if x]))
        out = [np.frombuffer(next(whole) if x else b"".join(map(young.__getitem__, words)), np.uint16) for words, x in zip(split, apart, strict=True)]
        for w in self.long:
            young.pop(w, None)
        self.long.clear()
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = Encoder(path, keep_space)
    return _ENCODERS[path, keep_space]
