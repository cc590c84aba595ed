"""SentencePiece encoding and decoding of byte-fallback BPE models, by vectorised merge rounds.

Text is cut where no piece of the vocabulary can reach across, so that each cut part ("word") can
be merged alone. The words of a batch that are not known yet are laid out in one flat array of
symbols. Each round finds for every word the least rank among its adjacent pairs (a segmented
minimum), merges that pair in all words at once, leftmost first, and compacts the array; words
without a pair left drop out. Ranks follow the model's scores; equal scores go to the leftmost pair,
as in the library. So a short word takes as many rounds as it has different merges.

Parts of more than LONG characters without a cut (letters run together, say) merge in each round all
pairs whose turn is sure to come, not the least alone (_merge_long), so that rounds stay few whatever the
length. Memory is about 100 bytes for each character of such a part.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import blocks, table

SPACE = "▁"
#: Bytes, as Words counts them, that a worker's remembered words may take; at the bound it forgets all and goes on.
CACHE_BYTES = 96 << 20
#: Characters of the longest word that is remembered; longer ones are encoded anew in each block.
CACHE_LONGEST = 200
#: Symbols merged at a time.
ROUND_SYMBOLS = 1 << 18
NONE = np.int64(1) << 40
#: Characters of a part without cuts beyond which all pairs that are sure to merge do so in one round.
LONG = 32


class Words(dict):
    """Ids, their decimal form and their number, by word: short words for as long as they fit, long ones for one block."""

    def __init__(self):
        super().__init__()
        self.block: dict = {}
        self.bytes = 0

    def __missing__(self, word: str):
        return self.block[word]

    def keep(self, word: str, entry: tuple) -> None:
        if len(word) > CACHE_LONGEST:
            self.block[word] = entry
            return
        self[word] = entry
        # strings and lists as CPython keeps them, with the entry's share of the table
        self.bytes += 400 + 4 * len(word) + 8 * len(entry[0]) + len(entry[1])

    def next_block(self) -> None:
        self.block = {}
        if self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a serialized message."""
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
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Vocabulary and merge table of a model file.

    Supports what byte-fallback BPE models of this kind use: identity normalization, an added
    leading space, kept white space and escaped spaces; anything else raises ValueError.
    """

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kinds = np.array(kinds)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and spaces before words are supported")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only identity normalization with a leading space and kept white space is supported")
        if {self.USER, self.UNUSED} & set(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.eos = next(i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if p == "</s>" and k == self.CONTROL)
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == self.BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self._tables(np.array(scores))
        self._decode_tables()

    def _tables(self, scores: np.ndarray) -> None:
        normal = {self.pieces[i]: i for i in np.flatnonzero(self.kinds == self.NORMAL)}
        chars = sorted({c for p in normal for c in p})
        self.char_list = np.array([ord(c) for c in chars])
        # symbols: pieces first, then known characters that are no piece of their own
        self.n_pieces = len(self.pieces)
        extra = {c: self.n_pieces + i for i, c in enumerate(c for c in chars if c not in normal)}
        self.extra_chars = list(extra)
        self.char_symbols = np.array([normal.get(c, extra.get(c, -1)) for c in chars], np.int64)
        symbol = normal | extra
        order = {s: r for r, s in enumerate(sorted({-scores[i] for i in normal.values()}))}
        keys, ranks, merged = [], [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(order[-scores[i]])
                    merged.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[at]
        self.pair_ranks = np.array(ranks, np.int64)[at]
        self.pair_merged = np.array(merged, np.int64)[at]
        # an open hash table over the pairs: one gather finds nearly all
        self.table = np.full(1 << 22, -1, np.int32)
        slots = self._slot(self.pair_keys)
        self.table[slots] = np.arange(len(slots))
        self.clashing = np.flatnonzero(self.table[slots] != np.arange(len(slots)))
        self.clashing_keys = np.append(self.pair_keys[self.clashing], -1 << 62)
        self.clashing_keys = np.sort(self.clashing_keys)
        # A pair may be merged all along a word in one round unless a merge with its result, or with
        # another pair of its score, could come before the pair's next occurrence.
        rank_of = {p: order[-scores[i]] for p, i in normal.items()}
        sooner = set()
        for piece, rank in rank_of.items():
            for k in range(1, len(piece)):
                for part in (piece[:k], piece[k:]):
                    if len(part) > 1 and rank_of.get(part, -1) >= rank:
                        sooner.add(part)
        counts = np.bincount(list(rank_of.values()))
        self.one_by_one = np.zeros(self.n_pieces, bool)
        for piece, i in normal.items():
            self.one_by_one[i] = piece in sooner or counts[rank_of[piece]] > 1
        self._trie(normal, rank_of)
        # cuts: between two characters that stand together in no piece
        self.joined = np.unique(np.array([ord(a) << 32 | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)], np.int64))
        runs = {len(p) for p in normal if set(p) == {SPACE}}
        self.longest_run = max(runs, default=1)
        # long runs of spaces are cut into the longest piece: only where leftmost merges do the same
        run, at = [1] * 3 * self.longest_run, 0
        while at < len(run) - 1:
            if run[at] + run[at + 1] in runs:
                run[at : at + 2], at = [run[at] + run[at + 1]], 0
            else:
                at += 1
        if run != [self.longest_run] * 3 or len({-scores[normal[SPACE * n]] for n in runs if n > 1}) > 1:
            raise ValueError("this model's pieces for runs of spaces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space after other characters are not supported")
        self.words = re.compile(rf"{SPACE}{{{self.longest_run}}}(?={SPACE})|{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _trie(self, normal: dict[str, int], rank_of: dict[str, int]) -> None:
        """Beginnings of pieces as numbered nodes: from a node and a character to the next, and what piece ends there."""
        nodes, steps = {"": 0}, {}
        for piece in normal:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    steps[nodes[piece[: k - 1]] << 21 | ord(piece[k - 1])] = nodes[piece[:k]]
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.node_rank, self.node_piece = np.full(len(nodes), NONE), np.full(len(nodes), -1, np.int64)
        for piece, i in normal.items():
            self.node_rank[nodes[piece]], self.node_piece[nodes[piece]] = rank_of[piece], i
        self.longest_piece = max(map(len, normal))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index in the pair list, -1 where a pair never merges."""
        at = self.table[self._slot(keys)].astype(np.int64)
        at[self.pair_keys[at] != keys] = -1
        rest = np.flatnonzero(at < 0)
        near = np.minimum(np.searchsorted(self.clashing_keys, keys[rest]), len(self.clashing_keys) - 1)
        hit = self.clashing_keys[near] == keys[rest]
        at[rest[hit]] = np.searchsorted(self.pair_keys, keys[rest[hit]])
        return at

    def _decode_tables(self) -> None:
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        for i, kind in enumerate(self.kinds):
            if kind == self.CONTROL:
                self.surface[i] = ""
            elif kind == self.UNKNOWN:
                self.surface[i] = " ⁇ "
            elif kind == self.BYTE:  # ASCII stands for itself even among other bytes
                self.surface[i] = chr(self.byte_of[i]) if self.byte_of[i] < 128 else None
        self.decimal = [str(i) for i in range(len(self.pieces))]

    # encoding

    def split(self, text: str) -> list[str]:
        """Words of a text, cut where no merge can cross."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = []
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size + len(words[end]) <= ROUND_SYMBOLS):
                size += len(words[end])
                end += 1
            out += self._encode(words[begin:end])
            begin = end
        return out

    def _encode(self, words: list[str]) -> list[list[int]]:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.char_list, codes), len(self.char_list) - 1)
        # characters that no piece holds get symbols below 0 and stay alone
        symbols = np.where(self.char_list[at] == codes, self.char_symbols[at], -1 - codes)
        pairs = codes[:-1] << 32 | codes[1:]
        near = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        cut = (self.joined[near] != pairs) | (word[1:] != word[:-1])
        part = np.concatenate(([0], np.cumsum(cut)))
        sizes = np.bincount(part)
        far = sizes[part] > LONG
        if far.any():
            long = self._merge_long(codes[far], symbols[far], part[far])
            near = self._merge(symbols[~far], part[~far])
            symbols, part = (np.concatenate(x) for x in zip(long, near, strict=True))
            order = np.argsort(part, kind="stable")
            symbols, part = symbols[order], part[order]
        else:
            symbols, part = self._merge(symbols, part)
        # words from parts, then bytes for what is no piece
        firsts = np.concatenate(([0], np.flatnonzero(cut) + 1))
        owner = word[firsts][part]
        return self._ids(symbols, owner, len(words))

    def _merge(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds; part numbers the segments, which stay in order."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(symbols))
        found = None
        while len(symbols):
            if found is None:
                keys = symbols[:-1] << 32 | symbols[1:]
                same = (part[:-1] == part[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
                found = np.full(len(symbols), -1, np.int64)
                found[:-1][same] = self._find(keys[same])
            rank = np.where(found >= 0, self.pair_ranks[found], NONE)
            begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sizes = np.diff(np.concatenate((begins, [len(part)])))
            least = np.minimum.reduceat(rank, begins)
            live = np.repeat(least < NONE, sizes)
            if not live.all():
                done.append((place[~live], symbols[~live], part[~live]))
                symbols, part, place, found, rank = (x[live] for x in (symbols, part, place, found, rank))
                if not len(symbols):
                    break
                sizes, least = sizes[least < NONE], least[least < NONE]
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            new = self.pair_merged[found[hits]]
            # of the hits of a word: the first only, or from the left all that don't overlap
            first = np.concatenate(([True], part[hits[1:]] != part[hits[:-1]]))
            chain = first | (np.diff(hits, prepend=-2) > 1)
            begin = np.maximum.accumulate(np.where(chain, np.arange(len(hits)), 0))
            chosen = np.where(self.one_by_one[new], first, (np.arange(len(hits)) - begin) % 2 == 0)
            hits, new = hits[chosen], new[chosen]
            symbols = symbols.copy()
            symbols[hits] = new
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            stale = np.zeros(len(symbols), bool)
            stale[hits] = True
            stale[hits[hits > 0] - 1] = True
            # a pair's left symbol may be dropped itself: then its left neighbour is stale too
            before = hits[hits > 1] - 2
            stale[before] = True
            symbols, part, place, found, stale = (x[keep] for x in (symbols, part, place, found, stale))
            look = np.flatnonzero(stale[:-1] & (part[:-1] == part[1:]))
            found[stale] = -1
            look = look[(symbols[look] >= 0) & (symbols[look + 1] >= 0)]
            found[look] = self._find(symbols[look] << 32 | symbols[look + 1])
        if not done:
            return symbols, part
        place, symbols, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], part[order]

    def _merge_long(self, codes: np.ndarray, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _merge(), with as many merges in a round as are sure to happen.

        One at a time, the least pair would merge, of equal ones the leftmost. So before a pair of rank r
        merges, others merge only if their rank is below r, or r and they stand to the left. Its left symbol can
        be lost to nothing but a piece that ends with it and begins at a symbol before it, its right symbol
        to nothing but a piece that begins with it and ends at a later symbol's end. If the text has no such
        piece of a rank that comes before r, the pair's turn is sure to come, wherever other merges happen.
        Of a chain of overlapping pairs of one rank every second merges, from the left.
        """
        n = len(codes)
        if not n:
            return symbols, part
        # nodes[k, p]: the trie's node for the k characters from p on, 0 if no piece begins so
        nodes = np.zeros((self.longest_piece + 1, n), np.int32)
        alive, node = np.arange(n), np.zeros(n, np.int64)
        for k in range(1, self.longest_piece + 1):
            inside = alive + k <= n
            alive, node = alive[inside], node[inside]
            inside = part[alive + k - 1] == part[alive]
            alive, node = alive[inside], node[inside]
            keys = node << 21 | codes[alive + k - 1]
            at = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
            hit = self.step_keys[at] == keys
            alive, node = alive[hit], self.step_to[at[hit]]
            if not len(alive):
                break
            nodes[k, alive] = node
        deepest = k

        def rank_of(begin, length):
            """Rank of the text of so many characters as a piece."""
            fits = (length <= deepest) & (begin >= 0) & (begin < n)
            return np.where(fits, self.node_rank[nodes[np.where(fits, length, 0), np.where(fits, begin, 0)]], NONE)

        begins, lengths = np.arange(n), np.ones(n, np.int64)
        edge = np.ones(n + 1, bool)  # where a symbol begins, and the end
        rank = np.append(rank_of(begins[:-1], lengths[:-1] + 1), NONE)
        while (live := rank < NONE).any():
            before = np.concatenate(([NONE], rank[:-1]))
            after = np.append(rank[1:], NONE)
            sure = np.flatnonzero(live & (rank <= before) & (rank <= after))
            r = rank[sure]
            left, right = begins[sure], begins[sure + 1]
            n_left, n_right = lengths[sure], lengths[sure + 1]
            neighbour = np.where(sure > 0, lengths[np.maximum(sure, 1) - 1], 0)
            ok = np.ones(len(sure), bool)
            for k in range(1, deepest):
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                # a symbol of k characters that could stand before the left symbol, or after the right one
                start = left[at] - k
                there = (start >= 0) & edge[np.maximum(start, 0)] & (k != neighbour[at])
                if k > 1:
                    there &= rank_of(start, np.full(len(at), k)) < NONE
                lost = there & (rank_of(start, n_left[at] + k) <= r[at])
                stop = right[at] + n_right[at] + k
                there = (stop <= n) & edge[np.minimum(stop, n)]
                if k > 1:
                    there &= rank_of(right[at] + n_right[at], np.full(len(at), k)) < NONE
                lost |= there & (rank_of(right[at], n_right[at] + k) < r[at])
                ok[at[lost]] = False
            sure, r = sure[ok], r[ok]
            # chains of overlapping pairs: equal ranks, as each is least beside the other
            linked = np.concatenate(([False], (sure[1:] == sure[:-1] + 1) & (r[1:] == r[:-1])))
            head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(sure))))
            # a chain whose first pair has an equal to its left that is not sure has to wait
            waits = before[sure] == r
            chosen = sure[((np.arange(len(sure)) - head) % 2 == 0) & ~waits[head]]
            # the least pair of all, leftmost, is always next
            chosen = np.union1d(chosen, [int(np.argmin(rank))])
            chosen = chosen[np.concatenate(([True], np.diff(chosen) > 1))]
            lengths[chosen] += lengths[chosen + 1]
            edge[begins[chosen + 1]] = False
            keep = np.ones(len(begins), bool)
            keep[chosen + 1] = False
            begins, lengths = begins[keep], lengths[keep]
            changed = np.zeros(len(keep), bool)
            changed[chosen] = True
            changed[chosen[chosen > 0] - 1] = True
            changed[chosen[chosen > 1] - 2] = True  # the symbol before the pair may be one that has just grown
            rank, changed = rank[keep], np.flatnonzero(changed[keep][:-1])
            rank[changed] = rank_of(begins[changed], lengths[changed] + lengths[changed + 1])
            rank[-1] = NONE
        return np.where(lengths > 1, self.node_piece[nodes[lengths, begins]], symbols[begins]), part[begins]

    def _ids(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> list[list[int]]:
        odd = (symbols < 0) | (symbols >= self.n_pieces)
        if odd.any():
            values, owners = [], []
            last = 0
            for i in np.flatnonzero(odd):
                s = int(symbols[i])
                char = chr(-1 - s) if s < 0 else self.extra_chars[s - self.n_pieces]
                data = self.byte_ids[np.frombuffer(char.encode("utf-8", "replace"), np.uint8)]
                values += [symbols[last:i], data]
                owners += [owner[last:i], np.full(len(data), owner[i])]
                last = i + 1
            symbols, owner = np.concatenate([*values, symbols[last:]]), np.concatenate([*owners, owner[last:]])
        bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
        ids = symbols.tolist()
        return [ids[a:b] for a, b in itertools.pairwise(bounds)]

    def encode(self, texts: list[str | None], cache: Words | None = None) -> list[list[int]]:
        """Ids of each text with an end id; null counts as empty."""
        cache = Words() if cache is None else cache
        split = [self.split(t or "") for t in texts]
        self.learn(split, cache)
        return [[i for w in words for i in cache[w][0]] + [self.eos] for words in split]

    def learn(self, split: list[list[str]], cache: Words) -> None:
        """Fills the cache with what it lacks of the words of a block."""
        cache.next_block()
        new = list({w for words in split for w in words}.difference(cache))
        decimal = self.decimal
        for w, ids in zip(new, self.encode_words(new), strict=True):
            cache.keep(w, (ids, " ".join([decimal[i] for i in ids]), len(ids)))

    # decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        if not ids:
            return ""
        surface = self.surface
        parts = [surface[i] for i in ids]
        # the leading space that encoding adds belongs to the first piece that shows
        for j, p in enumerate(parts):
            if p is None or p:
                if p and self.kinds[ids[j]] == self.NORMAL and p[0] == " ":
                    parts[j] = p[1:]
                break
        if None in parts:
            parts = self._with_bytes(parts, ids)
        return "".join(parts)

    def _with_bytes(self, parts: list, ids: list[int]) -> list[str]:
        out: list[str] = []
        run = bytearray()
        for p, i in zip(parts, ids, strict=True):
            if p is None:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(p)
        if run:
            out.append(_utf8(bytes(run)))
        return out


def _utf8(data: bytes) -> str:
    """Decoded bytes; each byte that starts no valid character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


#: Models, with the words that they have met, that a worker keeps from task to task.
_models: dict[bytes, tuple[Model, Words]] = {}


def _load(data: bytes) -> tuple[Model, Words]:
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = Model(data), Words()
    return _models[key]


def _stage(docs: DataFrame, path: str | None, row, columns: str, id_column: str, text_column: str) -> DataFrame:
    data = open(path or model_path(), "rb").read()
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        model, cache = _load(data)
        for batch in blocks(batches, text_column):
            split = [model.split(t or "") for t in batch.column(text_column).to_pylist()]
            model.learn(split, cache)
            yield row(model, cache, batch.column(id_column), split)

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {columns}")


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every text, ended by the end id.

    Null and empty texts give the end id alone. Rows are independent: repeated rows and ids give
    repeated results, null ids stay null, an empty table gives an empty one, other columns are
    ignored. Memory: one block of texts, or one text where that is longer, and CACHE_BYTES of words.
    """

    def row(model, cache, ids, split):
        lists = [[i for w in words for i in cache[w][0]] + [model.eos] for words in split]
        return pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int32()))], [id_column, "ids"])

    return _stage(docs, path, row, "ids array<int>", id_column, text_column)


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the text of every array of ids; null and empty arrays give empty texts."""
    data = open(path or model_path(), "rb").read()
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        model, _ = _load(data)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: both ways in one pass.

    The ids are those of encode() and are decoded as decode() does; cases as in encode().
    """

    def row(model, cache, ids, split):
        counts, shas, decoded = [], [], []
        end = str(model.eos)
        for words in split:
            found = [cache[w] for w in words]
            counts.append(sum(x[2] for x in found) + 1)
            shas.append(hashlib.sha256(" ".join([*(x[1] for x in found), end]).encode()).hexdigest())
            text = model.decode([i for x in found for i in x[0]] + [model.eos])
            decoded.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _stage(docs, path, row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", "doc_id", "text")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
