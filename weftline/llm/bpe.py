"""Token ids of whole texts by their distinct pieces: a text is cut where no token reaches across, a piece is encoded once.

Pieces of a block of texts are found with numpy over the bytes of Arrow columns, made distinct by
hash (and compared byte for byte with the piece that stands for them), and encoded by a tokenizer only
if the worker has not met them yet. Ids then are gathered for all occurrences at once.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

from weftline.llm import words

#: Bytes that a worker's remembered pieces may take, as Pieces counts them; at the bound it forgets all and goes on.
CACHE_BYTES = 96 << 20
#: Words that go to the library as one text.
JOINED = 256
#: Bytes of the longest piece that is remembered from block to block.
CACHE_LONGEST = 256


class Pieces:
    """Ids of pieces: short pieces are remembered for as long as they fit, long ones for one block.

    encode takes a list of pieces (bytes) and returns a list of lists of ids for each; check, given
    the same and the ids, says for each piece whether its tokens' bytes are its own.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], check: Callable[[bytes, list[int]], bool] | None = None):
        self.encode, self.check = encode, check
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.count, self.good = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.known, self.bytes = 0, 0

    def _add(self, new: list[bytes], long: dict[bytes, int]) -> None:
        lists = self.encode(new)
        counts = np.fromiter(map(len, lists), np.int64, len(new))
        total, known = int(counts.sum()), self.known + len(new)
        self.flat = grown(self.flat, self.used + total)
        self.first, self.count, self.good = (grown(x, known) for x in (self.first, self.count, self.good))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        self.first[self.known : known] = self.used + np.cumsum(counts) - counts
        self.count[self.known : known] = counts
        self.good[self.known : known] = True if self.check is None else [self.check(p, ids) for p, ids in zip(new, lists, strict=True)]
        for i, piece in enumerate(new, self.known):
            (self.number if len(piece) <= CACHE_LONGEST else long)[piece] = i
        self.bytes += 150 * len(new) + sum(map(len, new)) + 4 * total
        self.used, self.known = self.used + total, known

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the pieces data[starts[i]:ends[i]], for first, count and good; valid until the next call."""
        if self.bytes > CACHE_BYTES:
            self.forget()
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        lengths = ends - starts
        _, at, which = np.unique(words.hashes(padded, starts, lengths), return_index=True, return_inverse=True)
        same = words.equal(padded, starts, padded, starts[at][which], lengths) & (lengths == lengths[at][which])
        # a hash that two pieces share: those that differ from the first stand for themselves
        odd = np.flatnonzero(~same)
        which[odd] = len(at) + np.arange(len(odd))
        at = np.concatenate((at, odd))
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        number, long = self.number, {}
        known = list(map(number.get, distinct))
        new = [i for i, k in enumerate(known) if k is None]
        if new:
            self._add(list(dict.fromkeys([distinct[i] for i in new])), long)
            for i in new:
                p = distinct[i]
                known[i] = number[p] if p in number else long[p]
        return np.array(known, np.int64)[which]

    def ids(self, found: np.ndarray) -> np.ndarray:
        """Ids of pieces one after another."""
        return self.flat[ranges(self.first[found], self.count[found])]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for so many values."""
    while size > len(array):
        array = np.concatenate((array, np.zeros_like(array)))
    return array


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... count[0] of them, then those from first[1] on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


LETTER, NUMBER, BLANK, OTHER, UNSURE = 0, 1, 2, 3, 4
#: White space of the pattern: fixed values, the characters with the Unicode property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: Code points from here on are unsure: private ones, and those of no character.
KNOWN = 0x32400


@cache
def kinds() -> np.ndarray:
    """The kind of each code point, with UNSURE added where versions of Unicode may differ."""

    def kind(category: str) -> int:
        return {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)

    table = np.full(sys.maxunicode + 1, OTHER | UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(KNOWN):
        category = unicodedata.category(chr(c))
        now, before = kind(category), kind(old.category(chr(c)))
        table[c] = now | (UNSURE if category == "Cn" or now != before or category == "Zs" or old.category(chr(c)) == "Zs" else 0)
    table[list(WHITE)] = BLANK
    return table


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, unsure): where the pieces of the byte-level pattern start, and which texts have characters of unsure kind.

    The pattern is that of the tokenizer's file: contractions, runs of letters, numbers and others with
    one space before them, and white space, of which the last character before other text stands
    apart. Pieces end where the next one starts; each text starts one.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(place, offsets)
    kind = kinds()[points]
    unsure = np.add.reduceat(np.append(kind >= UNSURE, False), np.minimum(bounds[:-1], n)) > 0
    unsure &= bounds[1:] > bounds[:-1]
    kind = kind & 3
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    text = np.zeros(n + 1, bool)
    text[bounds] = True
    new |= text
    runs = np.flatnonzero(new[:n])
    ends = np.append(runs[1:], n)
    start = np.zeros(n + 1, bool)
    start[runs] = True
    blank = kind[runs] == BLANK
    last = ends[blank] - 1
    inner = ~text[ends[blank]]
    start[last[inner]] = True
    joined = inner & (points[last] == 32)
    start[ends[blank][joined]] = False
    # a contraction: an apostrophe that starts a piece, before letters
    lone = np.flatnonzero((kind[runs] == OTHER) & (points[runs] == 39) & (ends - runs == 1) & start[runs])
    lone = lone[lone + 1 < len(runs)]
    lone = lone[(kind[runs[lone + 1]] == LETTER) & ~text[runs[lone + 1]]]
    if len(lone):
        at, end = runs[lone] + 1, ends[lone + 1]
        one = points[at]
        two = points[np.minimum(at + 1, n - 1)]
        pair = (end - at > 1) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0))
        some = length > 0
        start[at[some]] = False
        rest = (at + length)[some]
        start[rest[rest < end[some]]] = True
    return place[np.flatnonzero(start[:n])], unsure


class ByteLevel:
    """A byte-level tokenizer file of the tokenizers library, with the pieces that a worker has met.

    plain says that the strings of special tokens within texts are ordinary text; then good tells of
    each text whether its tokens' bytes are its own.
    """

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = token_bytes(self.tokenizer)
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        # words after a space make up no added token
        self.joins = not any(t.content.replace(" ", "").isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pieces = Pieces(self._encode, self._is if plain else None)

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        some = [i for i, t in enumerate(texts) if t[:1] == " " and t[1:].isalpha()] if self.joins else []
        found = self._words([texts[i] for i in some], [len(pieces[i]) for i in some]) if len(some) > 1 else None
        if found is None:
            return self._each(texts)
        out: list = [None] * len(texts)
        for i, ids in zip(some, found, strict=True):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._each([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str], sizes: list[int]) -> list[list[int]] | None:
        """Ids of words with a space before each, which the pattern cuts one after another as it does alone: many as one text,
        which takes the library half the time. None if tokens' bytes do not end where the words do."""
        ids = np.array(list(chain.from_iterable(self._each(["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]))), np.int64)
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(np.array(sizes, np.int64))
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or not (ends[at] == wanted).all():
            return None
        flat, bounds = ids.tolist(), [0, *(at + 1).tolist()]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _is(self, piece: bytes, ids: list[int]) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == piece

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, good) of texts one after another in data: text i has ids first[i] to first[i + 1].

        Texts with special tokens, or characters whose kind depends on the version of Unicode, go to the library whole.
        """
        starts, whole = cuts(data, offsets)
        if self.special:
            raw = data.tobytes()
            if any(s in raw for s in self.special):
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    whole[i] |= any(s in raw[a:b] for s in self.special)
        if whole.any():
            ends = np.append(starts[1:], len(data))
            owner = np.searchsorted(offsets, starts, "right") - 1
            keep = ~whole[owner]
            starts, ends = np.concatenate((starts[keep], offsets[:-1][whole])), np.concatenate((ends[keep], offsets[1:][whole]))
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        else:
            ends = np.append(starts[1:], len(data))
        found = self.pieces.find(data, starts, ends)
        return gathered(self.pieces, found, starts, offsets)


def gathered(pieces: Pieces, found: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, good) of texts, of their pieces' numbers and starts."""
    bounds = np.searchsorted(starts, offsets)
    total = np.concatenate(([0], np.cumsum(pieces.count[found])))
    bad = np.concatenate(([0], np.cumsum(~pieces.good[found])))
    return pieces.ids(found), total[bounds], bad[bounds[1:]] == bad[bounds[:-1]]


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary: printable bytes stand for themselves, others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * tokenizer.get_vocab_size()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    for token, i in tokenizer.get_vocab().items():
        out[i] = added[i] if i in added else bytes(byte[c] for c in token)
    return out
