"""Language-model scores from a log-frequency Bloom filter.

Counting: workers hash the words, pairs and triples of whole training texts, add up equal ones over a
million words and send them on as packed arrays, dealt by hash; so a common word is one entry of an
array per worker batch, and all segments are alike. A task adds up a segment and builds its part of
the filter: an n-gram with count c is entered for every level whose least count c reaches. Probing
asks for level after level until one is missing; the last found is the quantised count. Triples are
entered from a count of two on, as is usual for that order.

Probabilities: the estimate of a pair, or triple, is the least count of its level divided by the most that its
context's level stands for. So estimates under one context
sum to one at most, but for words that the filter only seems to hold. How many these may be is known from
how full the filter is, and that much is added to the denominator (Totals.spare). Interpolation weights
depend on how often the context was seen, and are fitted on all training texts, each word's own
occurrence taken out. Estimates depend on a few levels only, so workers count tuples of levels, and the
fit needs no more than these counts, however large the corpus.

The filter, with exact word counts for the baseline, goes to the workers in broadcast pieces of at most
PIECE bytes. A block is as many pieces as BLOCK_MODEL holds; if the corpus needs more than one block, the
texts pass once for each, and carry what earlier blocks knew of their n-grams. A block is read from the shared
folder and sent when its pass begins, and freed when it ends, so that driver and workers hold one block
at a time on disk, and the driver one piece in memory. No training text is left out.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.llm.common import blocks, column, delete, input_bytes, plain, sweep, table, written
from weftline.llm.words import mix, scan



class Levels:
    """Quantised counts: one level for each count up to `exact`, then levels whose least counts grow by a factor."""

    def __init__(self, exact: int, growth: float, classes: int, top: int = 1 << 42):
        """classes: how many further levels share a class; weights are fitted for classes."""
        floors = list(range(exact + 1))
        while floors[-1] < top:
            floors.append(max(floors[-1] + 1, int(floors[-1] * growth)))
        self.floors = np.array(floors, np.int64)
        #: The most that a level stands for.
        self.most = np.append(self.floors[1:], 1 << 60) - 1
        number = np.arange(len(floors))
        #: The level that represents a level's class, and the level without one occurrence.
        self.representative = np.where(number <= 8, number, 8 + (number - 8) // classes * classes)
        self.without_one = np.where(number <= exact, np.maximum(number - 1, 0), number)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.floors, counts, "right") - 1).astype(np.uint8)


#: Levels of words, which are told apart finely, and of pairs and triples, which take a filter entry each.
WORDS, GRAMS = Levels(16, 1.12, 8), Levels(8, 1.25, 4)
#: Lanes of a filter: an entry sets some bits of one 64-bit cell in each.
LANES = 3
#: (bits of filter, bits set in a lane) for an n-gram's first entry, and for each further one, which is asked only
#: where the first is there.
FIRST, MORE = (28, 6), (12, 3)
#: Least level that an order's n-grams are entered at.
FIRST_LEVEL = {2: 1, 3: 2}
#: Most bytes of one broadcast, and of all that one pass over the texts uses.
PIECE, BLOCK_MODEL = 8 << 20, 512 << 20
#: Input bytes per segment, which decides how finely n-grams are dealt.
SEGMENT_BYTES = 4 << 20
#: Binary logarithm of the segments where the input's size is not known.
UNKNOWN_BITS = 8
#: Words that a worker adds up before it sends them on.
BATCH_WORDS = 3 << 20
#: Words that are probed, or levels that are scored, at a time.
PROBED, BLOCK_LEVELS = 1 << 17, 1 << 17
FOLDS, HELD_OUT = 5, 1
START, END = np.uint64(0x51A27), np.uint64(0xE2D)
#: What blocks so far knew of the words of a text.
STATE = {"counts": np.int64, "pairs": np.uint8, "triples": np.uint8}


def fold(ids: list) -> np.ndarray:
    """crc32 of each id as text, modulo FOLDS; a null id counts as empty text."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS for i in ids], np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, words, pairs, triples): hashes of each text's words and end, and of each with the one and two before it.

    A text's first word has a start before it; its triple is its pair with another start.
    """
    first, hashes, _, _ = scan(*plain(texts), "spaced")
    first = first + np.arange(len(first))
    words = np.empty(first[-1], np.uint64)
    ends = np.zeros(len(words), bool)
    ends[first[1:] - 1] = True
    words[ends] = END
    words[~ends] = hashes
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = START
    pairs = join(before, words)
    context = np.empty_like(words)
    context[1:] = pairs[:-1]
    context[first[:-1]] = START
    return first, words, pairs, join(context, words)


def join(context, word) -> np.ndarray:
    """Hash of a context, given by its hash, and the word after it."""
    return mix(np.asarray(context, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(word, np.uint64))


# counting


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def _key(hashes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Words keep their hash; n-grams as many of its bits as tell those of a corpus with 2**bits segments apart.

    Of all n-grams about one in 100,000 shares its key with another, no more than the filter itself confuses.
    """
    return hashes if order == 1 else hashes >> np.uint64(max(0, 28 - bits))


def _packed(grams: dict[int, list[np.ndarray]], bits: int):
    """Rows of (segment, order, n, steps, counts): each segment's hashes, ascending, as steps from one to the next."""
    rows: list[tuple] = []
    for order, parts in grams.items():
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        segments = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        bounds = np.flatnonzero(np.diff(segments, prepend=-1, append=-1))
        values = _key(values, order, bits)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows.append((int(segments[a]), order, b - a, _pack(np.diff(values[a:b], prepend=np.uint64(0))), _pack(counts[a:b])))
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["segment", "gram", "n", "steps", "counts"])
    yield from made.to_batches(max_chunksize=64)


def _sum(rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = np.concatenate([np.cumsum(_unpack(s, n), dtype=np.uint64) for n, s, _ in rows])
    counts = np.concatenate([_unpack(c, n) for n, _, c in rows]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    begins = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[begins], np.add.reduceat(counts, begins)


# the filter


def _cells(entries: np.ndarray, lane: int, set_: int, size) -> tuple[np.ndarray, np.ndarray]:
    """(cell, bits set in it) of entries in one lane of so many cells."""
    e = mix(entries + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 % 2**64))
    cell = ((e >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)
    bits = np.uint64(1) << (e & np.uint64(63))
    for k in range(1, set_):
        bits |= np.uint64(1) << ((e >> np.uint64(5 * k)) & np.uint64(63))
    return cell.astype(np.int64), bits


def _entry(grams: np.ndarray, level: int) -> np.ndarray:
    return grams * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(level * 0xC4CEB9FE1A85EC53 % 2**64)


def _filter(grams: np.ndarray, levels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(cells of first entries, cells of further ones, chances that either seems to hold what it does not)."""
    made, chances = [], []
    for steps, (bits, set_) in (((least,), FIRST), (range(least + 1, int(levels.max(initial=0)) + 1), MORE)):
        n = sum(int((levels >= step).sum()) for step in steps)
        size = max(1, -(-n * bits // (64 * LANES)))
        cells = np.zeros(LANES * size, np.uint64)
        for step in steps:
            entries = _entry(grams[levels >= step], step)
            for lane in range(LANES):
                at, mask = _cells(entries, lane, set_, size)
                np.bitwise_or.at(cells, at + lane * size, mask)
        made.append(cells)
        full = np.bitwise_count(cells).reshape(LANES, size) / 64
        chances.append(float(np.prod((full**set_).mean(axis=1))))
    return *made, *chances


#: Columns of a built segment.
SEGMENT = {"segment": "int", "words": "binary", "counts": "binary", "total": "bigint", "floors": "bigint", "distinct": "bigint"}
SEGMENT |= {c + str(g): t for g in FIRST_LEVEL for c, t in (("first", "binary"), ("more", "binary"), ("chance", "double"), ("chances", "double"))}
ARROW = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "bigint": pa.int64()}


def _build(group: pa.Table) -> pa.Table:
    """A segment: the exact counts of its words, and a filter of its pairs and one of its triples."""
    _free()
    kind = group.column("gram").to_pylist()
    rows = list(zip(*(group.column(c).to_pylist() for c in ("n", "steps", "counts")), strict=True))
    words, n = _sum([r for r, k in zip(rows, kind, strict=True) if k == 1])
    out = {"segment": group.column("segment")[0].as_py(), "words": words.tobytes(), "counts": n.tobytes(), "total": int(n.sum()), "floors": int(WORDS.floors[WORDS.of(n)].sum()), "distinct": len(words)}
    for order, least in FIRST_LEVEL.items():
        grams, counts = _sum([r for r, k in zip(rows, kind, strict=True) if k == order])
        levels = GRAMS.of(counts)
        first, more, chance, chances = _filter(grams[levels >= least], levels[levels >= least], least)
        out |= {f"first{order}": first.tobytes(), f"more{order}": more.tobytes(), f"chance{order}": chance, f"chances{order}": chances}
    return pa.table([pa.array([out[c]], ARROW[t]) for c, t in SEGMENT.items()], list(SEGMENT))


class Cells:
    """The cells of several segments' filters, one after another."""

    def __init__(self, size: np.ndarray, cells: np.ndarray, set_: int):
        """size: cells of each segment's lanes."""
        self.size, self.cells, self.set = size, cells, set_
        self.begin = (np.cumsum(size) - size) * LANES

    def holds(self, entries: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Indices of the entries that the filter of their segment (which) seems to hold."""
        left = np.arange(len(entries))
        for lane in range(LANES):
            own = which[left]
            at, mask = _cells(entries[left], lane, self.set, self.size[own])
            left = left[self.cells[self.begin[own] + lane * self.size[own] + at] & mask == mask]
        return left


class Block:
    """Some segments of the model, as a worker holds them."""

    def __init__(self, bits: int, segments: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, filters: dict[int, tuple[Cells, Cells]]):
        """sizes: words of each segment; words are in ascending order, as segments are their upper bits."""
        self.bits, self.segments, self.sizes, self.words, self.counts, self.filters = bits, segments, sizes, words, counts, filters
        self.place = np.full(1 << bits, -1, np.int64)
        self.place[segments] = np.arange(len(segments))

    @staticmethod
    def of_rows(bits: int, rows: list[dict]) -> Block:
        """rows: SEGMENT's columns by name."""
        rows = sorted(rows, key=lambda r: r["segment"])
        numbers = lambda c: np.array([r[c] for r in rows], np.int64)
        whole = lambda c, kind: np.frombuffer(b"".join([r[c] for r in rows]), kind)
        cells = lambda c, set_: Cells(np.array([len(r[c]) // (8 * LANES) for r in rows], np.int64), whole(c, np.uint64), set_)
        counts = whole("counts", np.int64)
        counts = counts if counts.max(initial=0) >> 32 else counts.astype(np.uint32)
        return Block(bits, numbers("segment"), numbers("distinct"), whole("words", np.uint64), counts, {g: (cells(f"first{g}", FIRST[1]), cells(f"more{g}", MORE[1])) for g in FIRST_LEVEL})

    def outline(self) -> tuple:
        """What of_pieces() must know beforehand."""
        return self.bits, self.segments, self.sizes, self.counts.dtype, {g: [f.size for f in pair] for g, pair in self.filters.items()}

    @staticmethod
    def of_pieces(outlines: list[tuple], pieces) -> Block:
        """One block of several with these outlines, which are asked for one after another and not kept."""
        bits, segments, sizes = outlines[0][0], *(np.concatenate([o[k] for o in outlines]) for k in (1, 2))
        order = np.argsort(segments)
        begins = np.empty(len(order), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        words, counts = np.empty(sizes.sum(), np.uint64), np.empty(sizes.sum(), max(o[3] for o in outlines))
        size = {g: [np.concatenate([o[4][g][k] for o in outlines]) for k in range(2)] for g in FIRST_LEVEL}
        filters = {g: tuple(Cells(n, np.empty(n.sum() * LANES, np.uint64), set_) for n, (_, set_) in zip(two, (FIRST, MORE), strict=True)) for g, two in size.items()}
        done, filled = 0, {(g, k): 0 for g in FIRST_LEVEL for k in range(2)}
        for piece in pieces:
            at = 0
            for begin, n in zip(begins[done : done + len(piece.segments)].tolist(), piece.sizes.tolist(), strict=True):
                words[begin : begin + n], counts[begin : begin + n] = piece.words[at : at + n], piece.counts[at : at + n]
                at += n
            done += len(piece.segments)
            for (g, k), at in filled.items():
                cells = piece.filters[g][k].cells
                filters[g][k].cells[at : at + len(cells)] = cells
                filled[g, k] = at + len(cells)
        return Block(bits, segments, sizes, words, counts, filters)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of words; 0 for what other pieces hold."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at].astype(np.int64), 0)

    def level(self, hashes: np.ndarray, order: int, found: np.ndarray) -> None:
        """Puts the levels of n-grams of this piece into found: the last in a row that the filter seems to hold."""
        which = self.place[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] if self.bits else np.zeros(len(hashes), np.int64)
        left = np.flatnonzero(which >= 0)
        grams = _key(hashes[left], order, self.bits)
        which, level = which[left], FIRST_LEVEL[order]
        first, more = self.filters[order]
        cells = first
        while len(left) and level < len(GRAMS.floors):
            held = cells.holds(_entry(grams, level), which)
            left, grams, which = left[held], grams[held], which[held]
            found[left] = level
            level += 1
            cells = more


def probe(block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact word counts, pair levels, triple levels); 0 for what other blocks hold."""
    distinct, back = np.unique(words, return_inverse=True)
    found = []
    for order, grams in ((2, pairs), (3, triples)):
        levels = np.zeros(len(words), np.uint8)
        for begin in range(0, len(grams), PROBED):
            block.level(grams[begin : begin + PROBED], order, levels[begin : begin + PROBED])
        found.append(levels)
    return block.count(distinct)[back], *found


#: The block that a worker holds, with its name; the pieces that it was made of are not kept.
_held: dict[str, Block] = {}


def _free() -> None:
    """A worker outlives its tasks; what it holds of a pass goes when it does something else."""
    _held.clear()


def _load(name: str, pieces: list) -> Block:
    if name not in _held:
        _held.clear()

        def each():
            for piece, _ in pieces:
                yield piece.value
                piece.__dict__.pop("_value", None)

        _held[name] = Block.of_pieces([outline for _, outline in pieces], each())
    return _held[name]


# probabilities


class Totals:
    """What scoring needs beside the filter: sums over the words, chances of false entries, interpolation weights."""

    def __init__(self, n: int, floors: int, v: int, chance: dict[int, float], chances: dict[int, float]):
        """n, floors, v: tokens, the sum of the least counts of the words' levels, distinct words; chance and chances:
        that a filter of an order falsely seems to hold a first, a further entry."""
        self.n, self.floors, self.v, self.chance, self.chances = n, floors, v, chance, chances
        self.weights = {2: np.full(len(WORDS.floors), 0.1), 3: np.full(len(GRAMS.floors), 0.1)}

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The baseline's probability of words by their exact counts."""
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))

    def spare(self, order: int, context: np.ndarray, after) -> np.ndarray:
        """Most that words which the filter falsely seems to hold, or to hold more often, add up to under a context.

        context: the most that the context's level stands for; after: how many words are asked for. How many
        of them seem to be there is all but Poisson distributed; five deviations beyond its mean, and one
        more, are hardly ever met. A further entry adds one, or a quarter of a count above eight.
        """
        first = after * self.chance[order]
        more = context * (1.25 * self.chances[order])
        return FIRST_LEVEL[order] * (1 + first + 5 * np.sqrt(first)) + more + 5 * np.sqrt(more)

    def estimates(self, words, pairs, triples, before, pairs_before):
        """(one, two, three): probabilities by word, pair and triple, of the levels of these and of the word and pair before.

        Level 0 stands for a word that no training text has, and for a text's first word's context.
        """
        one = (WORDS.floors[words] + 0.5) / (self.floors + 0.5 * (self.v + 1))
        known = (words > 0) & (before > 0)
        context = WORDS.most[before]
        two = np.where(known, GRAMS.floors[pairs], 0) / (context + self.spare(2, context, self.v))
        after = np.minimum(context, self.v)  # a triple is asked for only if its pair seems to be there
        context = GRAMS.most[pairs_before]
        there = known & (pairs > 0) & (pairs_before > 0) & (triples >= FIRST_LEVEL[3])
        three = np.where(there, GRAMS.floors[triples], 0) / (context + self.spare(3, context, after))
        return one, np.minimum(two, 1.0), np.minimum(three, 1.0)

    def shares(self, before, pairs_before) -> tuple[np.ndarray, np.ndarray]:
        """Weights of pair and triple for their contexts; none where there is no context."""
        two, three = self.weights[2][WORDS.representative[before]], self.weights[3][GRAMS.representative[pairs_before]]
        return np.where(before > 0, two, 0.0), np.where(pairs_before > 0, three, 0.0)

    def probability(self, words, pairs, triples, before, pairs_before) -> np.ndarray:
        one, two, three = self.estimates(words, pairs, triples, before, pairs_before)
        v, w = self.shares(before, pairs_before)
        return w * three + (1 - w) * (v * two + (1 - v) * one)

    def fit(self, levels: list[np.ndarray], times: np.ndarray, rounds: int = 20) -> None:
        """Interpolation weights by expectation maximisation.

        levels: arguments of estimates(), of tokens whose own occurrence is taken out, as representatives
        of their classes; times: how many tokens have them.
        """
        one, two, three = self.estimates(*levels)
        before, pairs_before = levels[3], levels[4]
        for _ in range(rounds):
            v, w = self.shares(before, pairs_before)
            lower = v * two + (1 - v) * one
            whole = w * three + (1 - w) * lower
            by_three, by_two = w * three / whole * times, (1 - w) * v * two / whole * times
            # classes seen little lean on a common prior
            for order, context, mine, all_ in ((2, before, by_two, np.where(before > 0, times - by_three, 0)), (3, pairs_before, by_three, np.where(pairs_before > 0, times, 0))):
                n = len(self.weights[order])
                self.weights[order] = (np.bincount(context, mine, n) + 1.0) / (np.bincount(context, all_, n) + 20.0)


def _before(first: np.ndarray, values: np.ndarray, start) -> np.ndarray:
    """What is known of the word before; start for a text's first word."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = start
    return out


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.empty(0)


# the model


class Model:
    """Totals, and blocks that are sent one after another."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, most: int = BLOCK_MODEL, segment_bytes: int = SEGMENT_BYTES):
        spark = docs.sparkSession
        rows = docs.select(column(id_column).alias("doc_id"), column(text_column).alias("text"))
        size = input_bytes(rows)
        # a plan that starts from no files has no known size
        bits = min(20, (size // segment_bytes).bit_length()) if size < 1 << 60 else UNKNOWN_BITS

        def count(batches):
            _free()
            grams, n = {1: [], 2: [], 3: []}, 0
            for batch in blocks(batches):
                batch = batch.filter(pa.array(fold(batch.column("doc_id").to_pylist()) != HELD_OUT))
                if not batch.num_rows:
                    continue
                _, *found = tokens(batch.column("text"))
                for parts, more in zip(grams.values(), found, strict=True):
                    parts.append(more)
                n += len(found[0])
                if n >= BATCH_WORDS:
                    yield from _packed(grams, bits)
                    grams, n = {1: [], 2: [], 3: []}, 0
            if n:
                yield from _packed(grams, bits)

        packed = rows.mapInArrow(count, "segment int, gram int, n bigint, steps binary, counts binary")
        built, folder = written(packed.groupBy("segment").applyInArrow(_build, ", ".join(f"{c} {t}" for c, t in SEGMENT.items())))
        sweep(spark)
        self.built, self.folder, self.bits = built, folder, bits
        false = [c + str(g) for g in FIRST_LEVEL for c in ("chance", "chances")]
        sizes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in SEGMENT.items() if t == "binary"), F.lit(0))
        # a row of numbers for each segment, of which there are at most 2^20
        rows = sorted(built.select(F.input_file_name(), "segment", sizes, "total", "floors", "distinct", *false).collect())
        share = dict(zip(false, (sum(r[6 + i] for r in rows) / max(len(rows), 1) for i in range(len(false))), strict=True))
        self.totals = Totals(*(sum(r[i] for r in rows) for i in (3, 4, 5)), *({g: share[c + str(g)] for g in FIRST_LEVEL} for c in ("chance", "chances")))
        self.blocks = Blocks(self, [r[:3] for r in rows], most)

    def close(self) -> None:
        delete(self.built.sparkSession, self.folder)


class Blocks:
    """The blocks of a model, each a name and broadcast pieces with their outlines, sent when it is asked for."""

    def __init__(self, model: Model, segments: list[tuple[str, int, int]], most: int):
        """segments: (file, number, bytes), in the order of files."""
        self.model, self.plan, size, held = model, [[[]]], 0, 0
        for file, number, n in segments:
            if size and size + n > most:
                self.plan.append([[]])
                size = held = 0
            elif held and held + n > PIECE:
                self.plan[-1].append([])
                held = 0
            self.plan[-1][-1].append((file, number))
            size, held = size + n, held + n

    def __len__(self) -> int:
        return len(self.plan)

    def __iter__(self):
        built, spark = self.model.built, self.model.built.sparkSession
        for pieces in self.plan:
            block = []
            for part in pieces:
                rows = []
                if part:
                    some = spark.read.schema(built.schema).parquet(*sorted({f for f, _ in part}))
                    rows = _rows(some.where(F.col("segment").isin([n for _, n in part])))
                piece = Block.of_rows(self.model.bits, list(rows))
                block.append((spark.sparkContext.broadcast(piece), piece.outline()))
            yield uuid.uuid4().hex, block


def _rows(df: DataFrame):
    """The rows of a small table as dictionaries, one after another."""
    found = df.toArrow()
    for k in range(found.num_rows):
        yield found.slice(k, 1).to_pylist()[0]


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = BLOCK_MODEL, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Learns from the texts whose crc32(id) modulo FOLDS is not HELD_OUT (a null id counts as empty text)
    and scores all. Null and empty texts have the end alone; repeated rows count and stay; an empty
    table gives an empty result; without training texts probabilities are those of the smoothing
    alone; other columns are ignored.
    """
    model = Model(docs, id_column, text_column, most, segment_bytes)
    totals, n_train = model.totals, model.totals.n
    state = StructType([StructField("id", docs.schema[id_column].dataType), *StructType.fromDDL("text string, " + ", ".join(f"{c} binary" for c in STATE)).fields])
    now = docs.select(column(id_column).alias("id"), column(text_column).alias("text"), *(F.lit(None).cast("binary").alias(c) for c in STATE))
    levels = StructType([state["id"], *StructType.fromDDL("held_out boolean, n_known bigint, base_score double, words binary, pairs binary, triples binary").fields])
    before = None
    for k, block in enumerate(model.blocks, 1):
        last = k == len(model.blocks)
        now, folder = written(now.mapInArrow(_last(block, totals, levels.names), levels) if last else now.mapInArrow(_pass(block), state))
        if before:
            delete(docs.sparkSession, before)
        before = folder
        _release(block)
    model.close()
    probed = now
    _fit(probed, totals)
    out = StructType([docs.schema[id_column], *StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])

    def finish(batches):
        _free()
        for batch in blocks(batches, "words", BLOCK_LEVELS):
            first, *found = _levels(batch)
            ids, held, known, base = (batch.column(i) for i in range(4))
            n = np.diff(first)
            score_ = _by_text(np.log10(totals.probability(*_seen(first, *found))), first)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(n), known, pa.array(np.full(len(n), n_train)), base, pa.array(score_)], names=out.names)

    return probed.mapInArrow(finish, out)


def _release(block) -> None:
    """Frees a block's broadcasts; what was computed with them is written."""
    for piece, _ in block[1]:
        piece.destroy()


def _known(block, batches):
    """(batch, first, counts, pair levels, triple levels), with what earlier blocks knew."""
    held = _load(*block)
    for batch in blocks(batches):
        first, *grams = tokens(batch.column("text"))
        found = []
        for (c, t), new in zip(STATE.items(), probe(held, *grams), strict=True):
            old = batch.column(c).to_pylist()
            if old[0] is not None:
                new = new + np.frombuffer(b"".join(old), t)
            found.append(new.astype(t))
        yield batch, first, *found


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(values, first[1:-1])], pa.binary())


def _pass(block):
    def run(batches):
        for batch, first, *found in _known(block, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_binary(x, first) for x in found)], names=batch.schema.names)

    return run


def _last(block, totals, names):
    """The last pass keeps the levels, and of the exact counts what results need."""

    def run(batches):
        for batch, first, counts, pairs, triples in _known(block, batches):
            held = fold(batch.column(0).to_pylist()) == HELD_OUT
            known, base = _by_text((counts > 0).astype(np.int64), first), _by_text(np.log10(totals.base(counts)), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(known), pa.array(base), *(_binary(x, first) for x in (WORDS.of(counts), pairs, triples))], names=names)

    return run


def _levels(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(first, levels of words, pairs, triples) of a batch of _last()."""
    found = [batch.column(c).to_pylist() for c in ("words", "pairs", "triples")]
    first = np.concatenate(([0], np.cumsum([len(x) for x in found[0]], dtype=np.int64)))
    return first, *(np.frombuffer(b"".join(x), np.uint8) for x in found)


def _seen(first, words, pairs, triples):
    """Arguments of Totals.estimates() from levels."""
    return words, pairs, triples, _before(first, words, 0), _before(first, pairs, 0)


def _fit(probed: DataFrame, totals: Totals) -> None:
    """Fits the weights on all training texts: at most one row for each tuple of classes reaches the driver."""

    def count(batches):
        _free()
        tuples, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in blocks(batches, "words", BLOCK_LEVELS):
            key = np.zeros(1, np.int64)
            for x, kind in zip(_seen(*_levels(batch)), (WORDS, GRAMS, GRAMS, WORDS, GRAMS), strict=True):
                key = key << 8 | kind.representative[kind.without_one[x]]
            found, n = np.unique(key, return_counts=True)
            tuples, back = np.unique(np.concatenate((tuples, found)), return_inverse=True)
            times = np.bincount(back, np.concatenate((times, n)), len(tuples)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tuples), pa.array(times)], ["levels", "n"])

    rows = probed.where("not held_out").select("words", "pairs", "triples")
    got = rows.mapInArrow(count, "levels bigint, n bigint").groupBy("levels").agg(F.sum("n").alias("n")).orderBy("levels").toArrow()
    tuples, times = (got.column(c).to_numpy() for c in ("levels", "n"))
    if len(tuples):
        totals.fit([tuples >> k & 255 for k in (32, 24, 16, 8, 0)], times)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
