"""Phrase collocations: contiguous phrases counted by direct-address tiling, scored by their weakest cut.

Words that occur often enough are ranked by frequency, and so are frequent pairs, then triples: a phrase is the pair of
its first words' rank and its last word's rank. Rank pairs fall into square tiles. A tile in which many pairs of a pass
fall is a dense array that numpy's bincount counts straight into; the pairs of sparse tiles are kept sorted as
coordinates with counts. Frequent pairs are ranked again and play the part of first words on the next level.

Ranks are sent to every task, so there is a bound to their number (``HEAD`` on each level). What is beyond is counted exactly
too, under its text instead of its rank; a bitmap of fixed size tells most of what can't be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.llm.common import _ASCII_LOWER, mixed, passes, text_bytes
from querytide.session import staged

LEAST = 30
LONGEST = 4
FIRST = 2000
# Of the longer phrase's occurrences against the shorter one's, in percent.
INSIDE = 80
SCORE_SCALE = 2_000_000
# Phrases ranked on a level; must not exceed 2**20, the bits of a rank in a code.
HEAD = 1 << 20
_RANK_BITS = 20
# Bits of a level's bitmap of what lies beyond the head, a power of two of 2**15 at least.
TAIL_BITS = 1 << 26
PASS_BYTES = 4 << 20
# A tile has so many ranks on a side (as bits), and is dense with so many pairs of a pass.
TILE_BITS = 9
DENSE = 8192
# Dense tiles held at once, and coordinates of sparse tiles held at once; more are sent on as they are.
HELD_TILES = 32
HELD_PAIRS = 1 << 22
# Copies of the counts that cuts look up, so that cuts with a common word spread out.
SALTS = 8
_NONE, _TAIL = -1, -2

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order (A-Z lower-cased), and the number of the piece that each stands in."""
    raw, offsets = text_bytes(texts)
    raw = _ASCII_LOWER[raw]
    kind = _KIND[raw]
    inside = kind == 0
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[: len(raw)]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    data = raw[inside]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return words, np.cumsum((kind == 2) | first)[starts]


def _by_language(batches) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for part in passes(batches, "text", PASS_BYTES):
        langs = part.column("lang")
        for lang in pc.unique(langs).to_pylist():
            words, pieces = tokens(part.column("text").filter(pc.equal(langs, lang)))
            if len(words):
                yield lang, words, pieces


def _batch(lang: str | None, phrases, counts, code=None) -> pa.RecordBatch:
    n = len(counts)
    phrases = pa.nulls(n, pa.string()) if phrases is None else phrases.cast(pa.string())
    code = pa.nulls(n, pa.int64()) if code is None else pa.array(code)
    return pa.RecordBatch.from_arrays([code, pa.repeat(pa.scalar(lang, pa.string()), n), phrases, pa.array(counts, pa.int64())], ["code", "lang", "phrase", "n"])


_COUNTED = "code long, lang string, phrase string, n long"


def _words(batches):
    """Occurrences of each word in a pass; all of a language's under a null word."""
    for lang, words, _ in _by_language(batches):
        found = pc.value_counts(words)
        yield _batch(lang, found.field("values"), found.field("counts"))
        yield _batch(lang, pa.nulls(1, pa.string()), [len(words)])


class TileCounts:
    """Counts of (first, last) rank pairs."""

    def __init__(self):
        self.tiles: dict[tuple[int, int], np.ndarray] = {}
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.pairs = self.counts = np.zeros(0, np.int64)

    def add(self, first: np.ndarray, last: np.ndarray) -> None:
        side = 1 << TILE_BITS
        row, column = first >> TILE_BITS, last >> TILE_BITS
        across = int(column.max(initial=0)) + 1
        tile = row * across + column
        dense = np.bincount(tile) >= DENSE if len(tile) else np.zeros(0, bool)
        there = dense[tile]
        inside = np.flatnonzero(there)
        inside = inside[np.argsort(tile[inside], kind="stable")]
        spots = ((first[inside] & (side - 1)) << TILE_BITS) | (last[inside] & (side - 1))
        numbers, begins = np.unique(tile[inside], return_index=True)
        for number, begin, end in zip(numbers.tolist(), begins, [*begins[1:], len(inside)]):
            key = divmod(number, across)
            found = np.bincount(spots[begin:end], minlength=side * side)
            self.tiles[key] = self.tiles[key] + found if key in self.tiles else found
        rest = ~there
        self.waiting.append((first[rest] << _RANK_BITS) | last[rest])
        self.n_waiting += len(self.waiting[-1])

    def _merge(self) -> None:
        new, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        pairs = np.concatenate([self.pairs, new])
        counts = np.concatenate([self.counts, counts])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        heads = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
        self.pairs, self.counts = pairs[heads], np.add.reduceat(counts, heads) if len(heads) else counts

    def ready(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts that are to be sent on: of all that is held in the end, before it where too much is held."""
        if self.n_waiting > HELD_PAIRS // 2 or last:
            self._merge()
        if len(self.pairs) > HELD_PAIRS or last and len(self.pairs):
            yield self.pairs, self.counts
            self.pairs = self.counts = np.zeros(0, np.int64)
        if len(self.tiles) > HELD_TILES or last:
            for (row, column), cells in self.tiles.items():
                spot = np.flatnonzero(cells)
                first, second = (row << TILE_BITS) | (spot >> TILE_BITS), (column << TILE_BITS) | (spot & ((1 << TILE_BITS) - 1))
                yield (first << _RANK_BITS) | second, cells[spot]
            self.tiles = {}


def _bit(lang: str, phrases: pa.Array) -> np.ndarray:
    """Place of a phrase in the bitmap of its level, by its text."""
    return np.array([xxhash.xxh64_intdigest(f"{lang}\n{p}") & (TAIL_BITS - 1) for p in phrases.to_pylist()], np.int64)


def _code_bit(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes.astype(np.uint64)) & np.uint64(TAIL_BITS - 1)).astype(np.int64)


class Ranks:
    """What is known of the levels so far: the words and phrases of each head in order of rank, and the bitmaps of the tails."""

    def __init__(self):
        self.words: dict[str, tuple[pa.Array, np.ndarray]] = {}
        self.lang_of, self.word_of = np.zeros(0, object), np.zeros(0, object)
        self.codes: dict[int, np.ndarray] = {}
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tails: dict[int, np.ndarray] = {}

    def add_words(self, langs: pa.Array, words: pa.Array) -> None:
        self.lang_of, self.word_of = (np.array(c.to_pylist(), object) for c in (langs, words))
        for lang in set(self.lang_of.tolist()):
            own = np.flatnonzero(self.lang_of == lang)
            self.words[lang] = pa.array(self.word_of[own].tolist(), pa.large_string()), own

    def add_level(self, n: int, codes: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        self.codes[n], self.sorted[n] = codes, (codes[order], order)

    def _marked(self, n: int, bits: np.ndarray) -> np.ndarray:
        return (self.tails[n][bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 > 0

    def word_states(self, lang: str, words: pa.Array) -> np.ndarray:
        """Per word its rank, or that it may be beyond the head, or that it isn't frequent."""
        own = words.dictionary_encode()
        state = np.full(len(own.dictionary), _NONE)
        if lang in self.words:
            known, ranks = self.words[lang]
            at = pc.fill_null(pc.index_in(own.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
            state[at >= 0] = ranks[at[at >= 0]]
        if 1 in self.tails:
            rest = np.flatnonzero(state == _NONE)
            marked = self._marked(1, _bit(lang, own.dictionary.take(pa.array(rest))))
            state[rest[marked]] = _TAIL
        return state[own.indices.to_numpy()]

    def phrases(self, lang: str, words: pa.Array, pieces: np.ndarray, n: int):
        """Of the phrases of ``n`` words whose shorter phrases may be frequent: first ranks, last ranks, and the texts of those without ranks."""
        word = state = self.word_states(lang, words)
        alive = (pieces[1:] == pieces[:-1]) & (state[1:] != _NONE) & (state[:-1] != _NONE)
        for m in range(2, n + 1):
            at = np.flatnonzero(alive)
            first, last = state[at], word[at + m - 1]
            coded = (first >= 0) & (last >= 0)
            named = at[~coded]
            at, first, last = at[coded], first[coded], last[coded]
            texts = pa.nulls(0, pa.large_string())
            if len(named):
                parts = [words.take(pa.array(named + i)) for i in range(m)]
                texts = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            if m == n:
                return first, last, texts
            codes, ranks = self.sorted[m]
            state = np.full(len(alive), _NONE)
            code = (first << _RANK_BITS) | last
            spot = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[spot] == code if len(codes) else np.zeros(len(code), bool)
            state[at[hit]] = ranks[spot[hit]]
            if m in self.tails:
                maybe = at[~hit]
                state[maybe[self._marked(m, _code_bit(code[~hit]))]] = _TAIL
                own = texts.dictionary_encode()
                state[named[self._marked(m, _bit(lang, own.dictionary))[own.indices.to_numpy()]]] = _TAIL
            alive = (state[1:] != _NONE) & (state[:-1] != _NONE)

    def decoded(self, n: int, codes: np.ndarray) -> tuple[list[str], list[str]]:
        """Languages and texts of phrases of ``n`` words with codes."""
        lasts = []
        for m in range(n, 1, -1):
            lasts.append(codes & ((1 << _RANK_BITS) - 1))
            first = codes >> _RANK_BITS
            codes = self.codes[m - 1][first] if m > 2 else first
        spots = [codes, *lasts[::-1]]
        return self.lang_of[codes].tolist(), [" ".join(words) for words in zip(*[self.word_of[s].tolist() for s in spots])]


def _phrases(known, n: int):
    def run(batches):
        ranks, counts = known.value, TileCounts()
        for lang, words, pieces in _by_language(batches):
            if len(words) < n:
                continue
            first, last, texts = ranks.phrases(lang, words, pieces, n)
            if len(texts):
                found = pc.value_counts(texts)
                yield _batch(lang, found.field("values"), found.field("counts"))
            counts.add(first, last)
            for code, n_found in counts.ready():
                yield _batch(None, None, n_found, code)
        for code, n_found in counts.ready(last=True):
            for begin in range(0, len(code), 1 << 18):
                rows = slice(begin, begin + (1 << 18))
                yield _batch(None, None, n_found[rows], code[rows])

    return run


def _named(known, n: int):
    """Texts of the phrases counted by code."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            coded = batch.filter(pc.is_valid(batch.column("code")))
            langs, phrases = known.value.decoded(n, coded.column("code").to_numpy())
            yield pa.RecordBatch.from_arrays([coded.column("code"), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), coded.column("n")], names)
            rest = batch.filter(pc.is_null(batch.column("code")))
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i in (1, 2) else c for i, c in enumerate(rest.columns)], names)

    return run


def _tail_bits(batches):
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            coded = own.filter(pc.is_valid(own.column("code")))
            texts = own.filter(pc.is_null(own.column("code"))).column("phrase")
            bits = np.concatenate([_code_bit(coded.column("code").to_numpy()), _bit(lang, texts)])
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 15), pa.array(bits & 32767)], ["page", "bit"])


def _take_level(ranks: Ranks, n: int, frequent: DataFrame) -> None:
    """Ranks the head of a level and marks its tail in a bitmap; at most ``HEAD`` rows and ``TAIL_BITS`` bits reach the driver."""
    usable = frequent if n == 1 else frequent.where("code IS NOT NULL")
    head = usable.orderBy(F.desc("n"), "lang", "phrase").limit(HEAD).toArrow()
    if n == 1:
        ranks.add_words(head["lang"], head["phrase"])
    else:
        ranks.add_level(n, head["code"].combine_chunks().to_numpy() if len(head) else np.zeros(0, np.int64))
    if frequent.count() > len(head):
        beyond = F.col("code").isNull() if n > 1 else F.lit(False)
        if len(head) == HEAD:
            last = head.slice(HEAD - 1).to_pylist()[0]
            tie = (F.col("lang") > last["lang"]) | ((F.col("lang") == last["lang"]) & (F.col("phrase") > last["phrase"]))
            beyond = beyond | (F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & tie)
        bits = frequent.where(beyond).mapInArrow(_tail_bits, "page long, bit long")
        pages = bits.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        marked = np.zeros(TAIL_BITS // 8, np.uint8)
        for r in pages:
            marked[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
        ranks.tails[n] = marked


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(``lang``, ``phrase``, ``words``, ``f``): all phrases of up to ``longest`` words that occur ``least`` times or more in a language.

    A row with a null phrase gives all word occurrences of the language.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where("text IS NOT NULL")
    counted = texts.mapInArrow(_words, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = staged(counted.where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    out = words.select("lang", "phrase", F.lit(1).alias("words"), F.col("n").alias("f"))
    ranks = Ranks()
    frequent = words.where("phrase IS NOT NULL").select(F.lit(None).cast("long").alias("code"), "lang", "phrase", "n")
    for n in range(2, longest + 1):
        _take_level(ranks, n - 1, frequent)
        known = spark.sparkContext.broadcast(ranks)
        # Without a tail all phrases have codes.
        keys = ["code", "lang", "phrase"] if ranks.tails else ["code"]
        counted = texts.mapInArrow(_phrases(known, n), _COUNTED).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        empty = F.lit(None).cast("string")
        counted = counted.select("code", *[F.col(c) if c in keys else empty.alias(c) for c in ("lang", "phrase")], "n")
        frequent = staged(counted.mapInArrow(_named(known, n), _COUNTED), "phrases")
        out = out.union(frequent.select("lang", "phrase", F.lit(n), F.col("n")))
    return out


def _joined(words: Column, begin, length) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def _cuts(counts: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: ``score``, ``k``, ``l``, ``r``."""
    words = F.split("phrase", " ")
    cut = counts.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        "lang", "phrase", F.col("f").alias("a"), "k", _joined(words, F.lit(1), F.col("k")).alias("_l"),
        _joined(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    parts = counts.where("phrase IS NOT NULL").select("lang", "phrase", "f", F.explode(F.lit(list(range(SALTS)))).alias("_salt"))
    # After the copies are made the planner still takes the size of the table before, and would broadcast all of them.
    for name in ("l", "r"):
        part = parts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name), "_salt")
        cut = cut.join(part.hint("merge"), ["lang", f"_{name}", "_salt"])
    # Whole numbers of more than 64 bits.
    return cut.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCORE_SCALE}) div CAST(l + r AS DECIMAL(20,0))"))


def _kept(counts: DataFrame) -> DataFrame:
    best = _cuts(counts).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best")).select("lang", "phrase", "a", "_best.*")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), b -> struct(b, m))))")
    longer = counts.where("words > 2").select("lang", "f", F.split("phrase", " ").alias("_words"), F.explode(spans).alias("_s"))
    longer = longer.select("lang", _joined(F.col("_words"), F.col("_s.b"), F.col("_s.m")).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < INSIDE * F.col("a"), F.lit(True)))
    return kept.select("lang", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``): every phrase of 2 to ``longest`` words with ``least`` occurrences or more in
    its language, less those that lie inside a longer one with ``INSIDE`` percent of their occurrences.

    A-Z is lower-cased; phrases don't cross ``.,;:!?`` or line ends. ``a``, ``l`` and ``r`` are the occurrences of the phrase and of the two parts of the
    cut with the lowest score, ``floor(SCORE_SCALE * a / (l + r))``, at equal scores the first cut.

    Null texts count as empty, a null language as ``und``. Repeated rows count as often as they occur. Texts of any length are
    read whole. Empty tables give no rows. Extra columns are left out.
    """
    return _kept(staged(phrase_counts(docs, text_col, lang_col, least, longest), "counts"))


def first_collocations(docs: DataFrame, first: int = FIRST, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``rank`` 1 to ``first`` of ``collocations`` per language, by score, then ``a``, both descending, then by the bytes of the phrase; and
    ``n``, all words of the language."""
    counts = staged(phrase_counts(docs, text_col, lang_col, least, longest), "counts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    ranked = _kept(counts).withColumn("rank", place).where(F.col("rank") <= first).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
