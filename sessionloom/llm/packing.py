"""Best-fit packing of tokenised documents into sequences by a configuration linear program.

Every document's ids, an end id after them, are cut into pieces of at most ``capacity`` tokens; only longer documents
are cut. The histogram of piece lengths (at most ``capacity`` counts, whatever the corpus holds) goes to the driver.
There the configuration program (cover each length's count by full-sequence patterns, as few as can be) is solved by
multiplicative weights: a length's price starts from its size and falls exponentially with the share of its pieces
already covered; a bounded knapsack dynamic program, over lengths drawn in proportion to the tokens and weights that they
have left, prices the best pattern, which is used as often as its rarest length allows: whole multiplicities, so each step is
rounded down as it is made. What is left of it (``TAIL`` of all tokens), and the gaps of the patterns, go to best fit decreasing over
groups of equal sequences. ``lower_bound`` has the dual side. All work on the driver is bounded by lengths and patterns, not documents.

Pieces then find their places without a global sort: a piece's rank among the pieces of its length is the offset of
its (length, salt) cell plus its number in the cell, where a length has as many salts as its count asks for; the plan turns
(length, rank) into sequence and offset.

``pieces`` takes tokenizers that lower-case letters, split at white space first and then keep runs of letters, digits and runs
of marks apart, the last token of each ending with ``</w>``, as the one of the query: words are coded once.

Null text counts as empty: the end id alone. Repeated rows are packed once each. An empty table packs to no rows.
"""

from __future__ import annotations

import bisect
import itertools
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm import arrowio

CAPACITY, END_ID, CACHE = 4096, 1, 500_000
#: How fast a length's price falls as its pieces are covered, the extra price of large ones, how much more lagging lengths
#: are drawn for a pricing, how many it looks at, and the share of all tokens that the program leaves to best fit.
RATE, LARGE, DRAW, PRICED, TAIL = 0.01, 0.002, 2.0, 96, 0.03
#: Bytes of text whose words are numbered at once: the more, the fewer words are looked up again.
CHUNK_BYTES = 2 << 20
#: Pieces of one length that one task numbers.
CELL = 1_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """word without white space -> its ids as little-endian unsigned 32-bit bytes, in two generations of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        # the same model for words of small letters, which neither the normaliser nor the pattern would change
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        mark = self._encode(self.tokenizer, [MARK])[0].tolist()
        self.mark = mark[0] if len(mark) == 1 else -1

    @staticmethod
    def _encode(tokenizer, texts: Sequence[str]) -> list[np.ndarray]:
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(e.ids, "<u4") for e in encode(list(texts), add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words not known yet. A call costs more than a word, so many go as one text, which is cut at the ids that end
        a word or at marks put between the words; long words and those that hold the mark go by themselves."""
        small, other, alone = [], [], []
        for w in words:
            (alone if len(w) > LONG or MARK in w else small if _SMALL(w) else other).append(w)
        for part in itertools.batched(small, PART):
            ids = self._encode(self.plain, [" ".join(part)])[0]
            after = np.flatnonzero(self.ends[ids]) + 1
            yield from self._cut(part, ids, after, after)
        for part in itertools.batched(other, PART):
            ids = self._encode(self.tokenizer, [f" {MARK} ".join([*part, ""])])[0]
            marks = np.flatnonzero(ids == self.mark)
            yield from self._cut(part, ids, marks, marks + 1)
        for part in itertools.batched(alone, PART):
            yield from self._single(part)

    def _single(self, words: Sequence[str]) -> Iterator[tuple[str, bytes]]:
        return zip(words, (ids.tobytes() for ids in self._encode(self.tokenizer, words)), strict=True)

    def _cut(self, words: Sequence[str], ids: np.ndarray, ends: np.ndarray, nexts: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """Each word's run of ids, by where it ends and where the next one begins; one by one if those aren't as many as words."""
        if len(ends) != len(words):
            return self._single(words)
        blob = ids.tobytes()
        return ((w, blob[a:b]) for w, a, b in zip(words, [0, *(4 * nexts[:-1]).tolist()], (4 * ends).tolist(), strict=True))

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words, which should be distinct."""
        out = list(map(self.young.get, words))
        open_ = [k for k, ids in enumerate(out) if ids is None]
        if len(self.young) + len(open_) > CACHE:
            self.young, self.old = {}, self.young
        places: dict[str, int] = {}
        for k in open_:
            w = words[k]
            if (ids := self.old.get(w)) is None:
                places[w] = k
            else:
                out[k] = self.young[w] = ids
        for w, ids in self._fresh(list(places)):
            out[places[w]] = ids
            if len(w) <= LONG:
                self.young[w] = ids
        return out


@arrowio.resident
def _word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


#: A character that is a piece by itself and whose id no other text has, between words that are coded as one text.
MARK = "\x01"
#: Longer words are coded one by one and not kept; words that one text holds.
LONG, PART = 128, 20_000
#: Small letters that normal forms leave alone, whatever follows among them.
_SMALL = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
_TAIL_MARKS = "".join(sorted(set(string.punctuation) - {"'"}))
#: Letters and digits that stay such in the tokenizer, whatever its version of Unicode.
_STEM_ENDS = pa.array(sorted({*string.ascii_letters, *string.digits, *map(chr, range(0xC0, 0x250))} - {"\xd7", "\xf7", "\u0130"}), pa.large_string())


def _stems_tails(words: pa.LargeStringArray) -> pa.LargeStringArray:
    """The stem and the tail of each word in turn. A run of ASCII marks after a letter or digit, at the word's end, is a
    piece by itself, so it goes to the tail: fewer stems are distinct.

    Not in words where a special token may stand, nor for apostrophes, which may begin a piece of letters.
    """
    stems = pc.ascii_rtrim(words, characters=_TAIL_MARKS)
    cut = pc.and_not(pc.is_in(pc.utf8_slice_codeunits(stems, -1), value_set=_STEM_ENDS), pc.match_substring(words, "<|"))
    sizes = pc.binary_length(pc.if_else(cut, stems, words)).to_numpy()
    _, places, blob = words.buffers()
    places = np.frombuffer(places, np.int64)[: len(words) + 1]
    both = np.empty(2 * len(words) + 1, np.int64)
    both[::2], both[1::2] = places, places[:-1] + sizes
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both), blob)


_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_SMALL_BLANKS = bytes.maketrans(string.ascii_uppercase.encode() + b"\n\t\r", string.ascii_lowercase.encode() + b"   ")


def _folded(text: bytes | None) -> bytes:
    """Fewer distinct words: the tokenizer lowers letters itself, so ASCII capitals may go first, except where a special
    token's text could arise."""
    return text.translate(_BLANKS if b"<|" in text else _SMALL_BLANKS) if text else b""


def text_ids(texts: list[bytes | None], path: str) -> list[bytes]:
    """Ids of each text as the tokenizer gives them for the whole text; its pieces never reach over white space.

    Arrow splits and numbers the words and puts their ids together again; Python sees each distinct word once.
    """
    if not texts:
        return []
    split = pc.split_pattern(pa.array(list(map(_folded, texts)), pa.large_string()), " ")
    words = split.values.dictionary_encode()
    parts = _stems_tails(words.dictionary).dictionary_encode()
    coded = _word_ids(path).ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
    _, places, blob = pa.array(coded, pa.large_binary()).take(parts.indices).buffers()
    # a word's tail lies behind its stem
    by_word = pa.py_buffer(np.frombuffer(places, np.int64)[: len(parts) + 1 : 2].copy())
    _, places, blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.dictionary), [None, by_word, blob]).take(words.indices).buffers()
    ends = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
    blob = memoryview(blob or b"")
    return [bytes(blob[a:b]) for a, b in itertools.pairwise(ends)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def kernel(ids, texts):
        rows = []
        for key, coded in zip(ids, text_ids(texts, path), strict=True):
            coded += end
            for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                part = coded[at : at + 4 * capacity]
                rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, PIECE_SCHEMA, CHUNK_BYTES)


def _knapsack(lengths: list[int], prices: list[float], bounds: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths of highest total price that fits, none more often than its bound: {length: times}."""
    best, steps = np.zeros(capacity + 1), []
    for n, price, bound in zip(lengths, prices, bounds, strict=True):
        bound, times = min(bound, capacity // n), 1
        while bound:
            times = min(times, bound)
            size = n * times
            value = best[:-size] + price * times
            taken = value > best[size:]
            np.copyto(best[size:], value, where=taken)
            steps.append((n, times, size, taken))
            bound -= times
            times *= 2
    out: dict[int, int] = defaultdict(int)
    room = capacity
    for n, times, size, taken in reversed(steps):
        if room >= size and taken[room - size]:
            out[n] += times
            room -= size
    return dict(out)


def _size_prices(lengths: np.ndarray, capacity: int) -> np.ndarray:
    share = lengths / capacity
    return share * (1 + LARGE * share)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the largest of the tokens' bound, the number of pieces of over half a sequence, and
    the dual value of the program's starting prices."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()])
    prices = _size_prices(lengths, capacity)
    place = {n: k for k, n in enumerate(lengths.tolist())}
    priced = sum(prices[place[n]] * k for n, k in _knapsack(lengths.tolist(), prices.tolist(), counts.tolist(), capacity).items())
    halves = int(counts[2 * lengths > capacity].sum())
    return max(-(-int(lengths @ counts) // capacity), halves, int(np.ceil(prices @ counts / priced - 1e-9)) if len(lengths) else 0)


def configuration_rounds(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Patterns with their whole multiplicities by multiplicative weights, and the counts that they leave over.

    A pattern's multiplicity is what the rarest of its lengths still allows, so each round is whole and uses up a length.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    place = {n: k for k, n in enumerate(lengths.tolist())}
    base, left, patterns = _size_prices(lengths, capacity), counts.copy(), []
    noise = np.random.default_rng(1)
    rest = TAIL * int(lengths @ counts)
    while int(lengths @ left) > rest:
        open_ = np.flatnonzero(left)
        # a length's price falls by a factor with each share of its pieces that is covered
        share_left = left[open_] / counts[open_]
        if len(open_) > PRICED:
            drawn = np.log(lengths[open_] * left[open_]) + DRAW * share_left + noise.gumbel(size=len(open_))
            some = np.argpartition(-drawn, PRICED)[:PRICED]
            open_, share_left = open_[some], share_left[some]
        prices = base[open_] * np.exp(RATE * share_left)
        chosen = _knapsack(lengths[open_].tolist(), prices.tolist(), left[open_].tolist(), capacity)
        places, times = [place[n] for n in chosen], list(chosen.values())
        used = min(int(left[k]) // m for k, m in zip(places, times, strict=True))
        patterns.append((used, tuple(n for n in sorted(chosen, reverse=True) for _ in range(chosen[n]))))
        left[places] -= used * np.array(times)
    return patterns, {n: c for n, c in zip(lengths.tolist(), left.tolist(), strict=True) if c}


def best_fit(patterns: list[tuple[int, tuple[int, ...]]], left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing over groups of equal sequences: (number of sequences, lengths in order)."""
    open_by_gap: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, count: int, lengths: tuple) -> None:
        if not open_by_gap[gap]:
            bisect.insort(gaps, gap)
        open_by_gap[gap].append([count, lengths])

    for count, lengths in patterns:
        put(capacity - sum(lengths), count, lengths)
    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                fit = capacity // length
                if need >= fit:
                    put(capacity - fit * length, need // fit, (length,) * fit)
                if need % fit:
                    put(capacity - need % fit * length, 1, (length,) * (need % fit))
                break
            gap = gaps[k]
            count, lengths = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del gaps[k]
            used = min(need, count)
            if count > used:
                put(gap, count - used, lengths)
            put(gap - length, used, (*lengths, length))
            need -= used
    merged: dict[tuple, int] = defaultdict(int)
    for groups in open_by_gap.values():
        for count, lengths in groups:
            merged[lengths] += count
    return [(count, lengths) for lengths, count in sorted(merged.items(), reverse=True)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in order) for all pieces of the histogram."""
    full = {n: c for n, c in histogram.items() if n == capacity}
    rest = {n: c for n, c in histogram.items() if 0 < n < capacity}
    # both roundings of the program: of its patterns, and of none of them
    made = min((best_fit(*configuration_rounds(rest, capacity), capacity), best_fit([], rest, capacity)), key=lambda m: sum(c for c, _ in m))
    return [(c, (n,)) for n, c in full.items()] + made


def _places(made: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list, list]]:
    """length -> (first ranks, (first sequence, offsets in it)) in order of rank."""
    out: dict[int, tuple[list, list]] = {}
    seen: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in made:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for n in lengths:
            offsets[n].append(at)
            at += n
        for n, places in offsets.items():
            first, place = out.setdefault(n, ([], []))
            first.append(seen[n])
            place.append((sequence, places))
            seen[n] += count * len(places)
        sequence += count
    return out


def pack(made_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length."""
    kept = arrowio.stage(made_pieces)
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    # a row for each length: at most ``capacity`` of them
    salts = kept.sparkSession.createDataFrame([(n, 1 + c // CELL) for n, c in histogram.items()], "length long, __salts long")
    salted = kept.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__salts")))
    cells = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("length", "__salt", before.alias("__before"))
    number = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("__number", number).join(cells, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__number"))
    columns = kept.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, sequence_id long, offset long"

    @arrowio.lean
    def place(batches):
        for batch in batches:
            ids, offsets = [], []
            for length, rank in zip(batch.column(columns.index("length")).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                first, found = places[length]
                k = bisect.bisect_right(first, rank) - 1
                sequence, slots = found[k]
                copy, slot = divmod(rank - first[k], len(slots))
                ids.append(sequence + copy)
                offsets.append(slots[slot])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "__rank").mapInArrow(place, schema)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(arrowio.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
