"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training rows, by slices of the hash range; each
task packs its counts by slice, and where a slice's counts meet they are summed.  A count c is quantised to a
level q = 1 + floor(log c / log STEP), and the n-gram is put into the slice's part of the filter once
for each level up to q; asking for levels 1, 2, ... until one is absent gives the level back.  A level
stands for the mean count of the n-grams on it, so the counts of all words, and of all pairs, sum to what
they are.  The number of slices and the bits of each follow from the data: no n-gram is left out.

The probability of a word after another is the Dirichlet-smoothed estimate

    (c(v, w) + prior * p(w)) / (c(v) + prior),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

whose prior is learned: it is the one with which all contexts together give the smoothing the share of
tokens that Good and Turing's rule expects to be new pairs, (pairs seen once) / N.  Where a pair is absent, the
filter says so but for under 1 % of the pairs asked for; these add to the mass of the next word.

Texts of up to `max_bits` bits whose filter has no more are scored by tasks to which it is sent, with the exact counts
of up to `broadcast_words` words (for the base score).  Beyond any of these bounds no filter is kept.
Rows are written in rounds of some millions of tokens, as places in the round's words.  A round sends each of its words
and pairs once to their slice, which counts them, makes its part of the filter, asks it for all of them and answers each
round in the order in which it asked.  Words and pairs are sorted by hash, so the answers of a round, by
slice, are in the order of its own words and pairs, and neither hashes nor sums of rows are sent back.

Empty table: no rows.  Null text: empty, so its end token alone.  A null id counts as the text '' for
the split.  Repeated rows are counted and scored as often as they occur.  Without training rows
every count is 0, N = V = 0.  Very long texts are whole; ties do not arise.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import gram_hashes, hashed_words, learned_from, mix, slices, stage

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D)
STEP, BITS_EACH, LEVELS = 1.5, 12, 64
PAIR = np.uint64(0x632BE59BD9B4E019)
#: Slices of the hash range at least, and bytes of text for each.
LEAST_SLICES, SLICE_BYTES = 4096, 64 << 20


def flat_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words, end of each text, end to end; the number of tokens (words and end) of each."""
    words, at = hashed_words(texts)
    sizes = np.diff(at) + 1
    ends = np.cumsum(sizes + 1)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(flat), bool)
    flat[ends - sizes - 1], flat[ends - 1] = BEGIN, END
    inner[ends - sizes - 1] = inner[ends - 1] = False
    flat[inner] = words
    return flat, sizes


def pairs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens in `flat`, and the hash of each with the one before it."""
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    token = np.ones(len(flat), bool)
    token[begins] = False
    at = np.flatnonzero(token)
    return at, gram_hashes(flat, 2)[at - 1] ^ PAIR


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(STEP) + 1e-9).astype(np.int64)


def slice_of(keys: np.ndarray, n_slices: int) -> np.ndarray:
    """The slice of hashes: their leading bits, so sorted hashes are sorted by slice."""
    return (keys >> np.uint64(65 - n_slices.bit_length())).astype(np.int64)


def sent_bytes(n_slices: int) -> int:
    """Bytes of a hash that its slice is sent: the highest follows from the slice where there are 256 or more."""
    return 8 - (n_slices >= 256)


def shortened(keys: np.ndarray, n_slices: int) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : sent_bytes(n_slices)]


def lengthened(sent: bytes, s: int, n_slices: int) -> np.ndarray:
    """The hashes of slice `s` that were shortened."""
    width = sent_bytes(n_slices)
    keys = np.full((len(sent) // width, 8), s * 256 // n_slices, np.uint8)
    keys[:, :width] = np.frombuffer(sent, np.uint8).reshape(-1, width)
    return keys.view(np.uint64).ravel()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their n, and the place of each key among them."""
    if not len(keys):
        return keys, n, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.append(True, keys[1:] != keys[:-1])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(first) - 1
    return keys[first], np.add.reduceat(n, np.flatnonzero(first)), at


# ---- the filter: an n-gram at a level sets four bits in each of two 64-bit words of its slice ----


def marks(keys: np.ndarray, lev: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the two words: 32 bits that choose it, and 24 bits that choose its four bits."""
    a = mix(keys + np.asarray(lev).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    yield a >> np.uint64(32), a
    b = mix(a ^ PAIR)
    yield b >> np.uint64(32), b


def words_for(insertions: int) -> int:
    """64-bit words of a slice with so many insertions."""
    return max(1, -(-insertions * BITS_EACH // 64))


def fill(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """64-bit words of one slice with its n-grams at all their levels."""
    size = words_for(int(levels.sum()))
    bits = np.zeros(size * 64, bool)
    each = np.repeat(keys, levels)
    lev = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    for place, four in marks(each, lev):
        at = (place * np.uint64(size) >> np.uint64(32)) << np.uint64(6)
        for k in range(4):
            bits[at + (four >> np.uint64(6 * k) & np.uint64(63))] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Filter:
    words: np.ndarray  # of uint64, slice after slice
    starts: np.ndarray  # where each slice begins, and the end

    def present(self, keys: np.ndarray, base: np.ndarray, size: np.ndarray, lev: int) -> np.ndarray:
        hit, one = np.ones(len(keys), bool), np.uint64(1)
        for place, four in marks(keys, lev):
            want = one << (four & np.uint64(63))
            for k in range(1, 4):
                want |= one << (four >> np.uint64(6 * k) & np.uint64(63))
            hit &= self.words[base + (place * size >> np.uint64(32))] & want == want
        return hit

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if not len(self.words):
            return out
        s = slice_of(keys, len(self.starts) - 1)
        base, size = self.starts[s].astype(np.uint64), np.diff(self.starts)[s].astype(np.uint64)
        lev = 0
        while len(left) and lev < LEVELS - 1:
            lev += 1
            left = left[self.present(keys[left], base[left], size[left], lev)]
            out[left] = lev
        return out


# ---- the model ----


def learned_prior(n: int, word_counts: np.ndarray, word_sums: np.ndarray, once: int) -> float:
    """The prior by Good and Turing's rule, from the numbers of words and the sums of counts by level."""
    own = word_sums > 0
    if not n or not once or not own.any():
        return 1.0
    mean, share = word_sums[own] / word_counts[own], word_sums[own] / word_sums[own].sum()
    lo, hi, new = -10.0, 20.0, min(once / n, 0.999)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share / (1 + mean / np.exp(mid))).sum() < new else (lo, mid)
    return float(np.exp(lo))


@dataclass(frozen=True)
class Model:
    n: int
    v: int
    prior: float
    word_value: np.ndarray  # the count that a level stands for
    pair_value: np.ndarray

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.n + 0.1 * (self.v + 1))

    def context_log10(self, before: np.ndarray) -> np.ndarray:
        return np.log10(self.word_value[before] + self.prior)

    def pair_log10(self, pair: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What a token's log10 probability is above minus that of its context, by the levels of its pair and of itself."""
        return np.log10(self.pair_value[pair] + self.prior * self.unigram(self.word_value[own]))


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a table sorted by its first column, and which keys it has."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return i, table[0][i] == keys


COUNTED = "slice int, round long, words binary, word_n binary, once binary, more binary, more_n binary"


def dealt(round_: int, words: np.ndarray, word_n: np.ndarray, grams: np.ndarray, gram_n: np.ndarray, n_slices: int) -> pa.RecordBatch:
    """Sorted words and pairs with their counts, packed by slice: a row of COUNTED for each that has any."""
    once, bounds = gram_n == 1, np.arange(1, n_slices).astype(np.uint64) << np.uint64(65 - n_slices.bit_length())
    own = np.union1d(slice_of(words, n_slices), slice_of(grams, n_slices))

    def packed(keys: np.ndarray, values: np.ndarray) -> pa.Array:
        edges = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
        offsets = np.append(edges[own], edges[own[-1] + 1]) * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
        return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    columns = [(words, shortened(words, n_slices)), (words, word_n.astype(np.uint32)), *((x, shortened(x, n_slices)) for x in (grams[once], grams[~once])), (grams[~once], gram_n[~once].astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), round_)), *(packed(k, x) for k, x in columns)], names=names_of(COUNTED))


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def counted(docs: DataFrame, n_slices: int) -> DataFrame:
    """Counts of words (the begin mark too) and pairs as their tasks saw them: a row for each slice and round, with
    hashes (`shortened`) and 32-bit counts packed; pairs seen once without a count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def told() -> pa.RecordBatch:
            words, grams = (np.unique(np.concatenate(x), return_counts=True) for x in zip(*held, strict=True))
            return dealt(0, *words, *grams, n_slices)

        for batch in batches:
            for some in slices(batch, "text"):
                flat, sizes = flat_tokens(some.column(0))
                held.append((flat, pairs(flat, sizes)[1]))
                size += len(flat) * 2
                if size > 6_000_000:
                    yield told()
                    held.clear()
                    size = 0
        if held:
            yield told()

    return docs.select("text").mapInArrow(count, COUNTED)


MERGED = "round long, slice int, bits binary, words binary, word_n binary, word_lev binary, once_lev binary, more_lev binary, word_counts array<long>, word_sums array<long>, pair_counts array<long>, pair_sums array<long>"


def merged(parts: DataFrame, n_slices: int, answer: bool) -> DataFrame:
    """One row for each slice, without a round: numbers and sums of counts by level (without the begin mark).  It has
    the slice's filter and its words with counts; with `answer` these stay out, and each round gets a row:
    the counts of its words, and the levels that the filter tells of its words, its pairs seen once and its others."""
    names = names_of(MERGED)
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 6 + [pa.list_(pa.int64())] * 4

    def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(rows, kind)) for name, kind in zip(names, kinds, strict=True)], names=names)

    def numbers(counts: np.ndarray, levels: np.ndarray) -> list[pa.Array]:
        return [pa.array([np.bincount(levels, minlength=LEVELS).tolist()], kinds[-1]), pa.array([np.bincount(levels, counts, LEVELS).astype(np.int64).tolist()], kinds[-1])]

    def one(s: int, held: list[list]) -> Iterator[pa.RecordBatch]:
        rounds, *blobs = zip(*held, strict=True)
        words, once, more = (lengthened(b"".join(blobs[k]), s, n_slices) for k in (0, 2, 3))
        word_n, more_n = (np.frombuffer(b"".join(blobs[k]), np.uint32) for k in (1, 4))
        words, word_n, word_at = summed(words, word_n.astype(np.int64))
        grams, gram_n, gram_at = summed(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), more_n.astype(np.int64)]))
        w, g = word_n > 0, gram_n > 0  # held-out rows ask for words and pairs that no other row has
        word_lev, gram_lev = level(word_n[w]), level(gram_n[g])
        bits = fill(np.concatenate([words[w], grams[g]]), np.concatenate([word_lev, gram_lev]))
        real = words[w] != BEGIN
        sums = dict(zip(names[-4:], numbers(word_n[w][real], word_lev[real]) + numbers(gram_n[g], gram_lev), strict=True))
        filled = {} if answer else {k: pa.array([x.tobytes()], pa.binary()) for k, x in (("bits", bits), ("words", words), ("word_n", word_n))}
        yield batch(1, slice=pa.array([s], kinds[1]), **filled, **sums)
        if answer:
            own = Filter(bits, np.array([0, len(bits)]))
            word_said, gram_said = (own.levels(x).astype(np.uint8)[at] for x, at in ((words, word_at), (grams, gram_at)))

            def packed(values: np.ndarray, of: tuple[bytes, ...]) -> pa.Array:
                """What is said of the hashes that each round sent."""
                offsets = np.cumsum([0, *map(len, of)]) // sent_bytes(n_slices) * values.itemsize
                return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

            said = {"word_n": packed(word_n[word_at], blobs[0]), "word_lev": packed(word_said, blobs[0]), "once_lev": packed(gram_said[: len(once)], blobs[2]), "more_lev": packed(gram_said[len(once) :], blobs[3])}
            yield batch(len(rounds), round=pa.array(rounds, kinds[0]), slice=pa.array([s] * len(rounds), kinds[1]), **said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for s, some in runs(batches):
            if s != now and held:
                yield from one(now, held)
                held = []
            now = s
            held += [list(x) for x in zip(*(some.column(k).to_pylist() for k in range(1, 7)), strict=True)]
        if held:
            yield from one(now, held)

    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, MERGED)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of equal whole numbers in the first column of batches that come sorted by it."""
    for batch in batches:
        s = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield int(s[a]), batch.slice(a, b - a)


def gathered(table: DataFrame, *types: type) -> tuple[np.ndarray, ...]:
    """The packed columns of (slice, ...), end to end in the order of the slices: the hashes come out sorted."""
    found = {r[0]: r[1:] for r in table.toLocalIterator()}
    return tuple(np.concatenate([np.empty(0, t), *(np.frombuffer(found[s][k], t) for s in sorted(found))]) for k, t in enumerate(types))


def made_filter(table: DataFrame, n_slices: int) -> Filter:
    """The whole filter, on the driver."""
    parts = {r["slice"]: np.frombuffer(r["bits"], np.uint64) for r in table.select("slice", "bits").toLocalIterator()}
    none = np.zeros(1, np.uint64)
    each = [parts.get(s, none) for s in range(n_slices)]
    return Filter(np.concatenate(each), np.cumsum([0, *map(len, each)]))


# ---- beyond the bounds: rounds of rows, whose words and pairs are counted and answered by their slices ----

#: Tokens of a round, and the bytes from which a row group of rounds is written (each is a row of some megabytes).
ROUND, ROUND_FILE = 2_000_000, {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
ROUNDS = "round long, ids array<long>, held array<boolean>, sizes array<long>, hashes binary, places binary"


def rounds(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, held_out) in rounds: hashes of their words, the most frequent first, and the place among these of
    each token, by bytes (the lowest byte of all places first) as they compress better so."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def one() -> pa.RecordBatch:
            flat, sizes = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            words, back, n = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            planes = np.ascontiguousarray(place[back].view(np.uint8).reshape(-1, 4).T)
            listed = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (*(pa.concat_arrays([y[k] for y in held]) for k in (2, 3)), pa.array(sizes))]
            blobs = [pa.array([x], pa.binary()) for x in (words[order].tobytes(), pa.compress(planes, "zstd", asbytes=True))]
            return pa.RecordBatch.from_arrays([pa.array([first + told]), *listed, *blobs], names=names_of(ROUNDS))

        for batch in batches:
            for some in slices(batch, "text"):
                held.append((*flat_tokens(some.column(1)), some.column(0), some.column(2)))
                size += len(held[-1][0])
                if size >= ROUND:
                    yield one()
                    told, held, size = told + 1, [], 0
        if held:
            yield one()

    return rows.select("doc_id", "text", "held_out").mapInArrow(read, ROUNDS)


@dataclass(frozen=True)
class Round:
    """The rows of a round with their sorted distinct words and pairs, their counts in training rows, and the places of the
    tokens' (with the begin marks for words) among them."""

    ids: pa.Array
    held: pa.Array
    sizes: np.ndarray
    words: np.ndarray
    word_n: np.ndarray
    word_at: np.ndarray
    tokens: np.ndarray  # where the words are that are tokens
    grams: np.ndarray
    gram_n: np.ndarray
    gram_at: np.ndarray


def opened(row: pa.RecordBatch) -> Round:
    """The round of a row of ROUNDS."""
    ids, held, sizes, hashes, places = (row.column(row.schema.get_field_index(c)) for c in names_of(ROUNDS)[1:])
    ids, held, sizes = (x.flatten() for x in (ids, held, sizes))
    sizes, hashes = sizes.to_numpy(), np.frombuffer(hashes[0].as_py(), np.uint64)
    n_flat = int(sizes.sum()) + len(sizes)
    planes = np.frombuffer(pa.decompress(places[0].as_buffer(), 4 * n_flat, "zstd"), np.uint8)
    place = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    order = np.argsort(hashes)
    sorted_place = np.empty(len(order), np.int32)
    sorted_place[order] = np.arange(len(order), dtype=np.int32)
    flat, word_at = hashes[place], sorted_place[place]
    at, keys = pairs(flat, sizes)
    grams, gram_at = np.unique(keys, return_inverse=True)
    train = ~held.to_numpy(zero_copy_only=False)
    word_n = np.bincount(word_at[np.repeat(train, sizes + 1)], minlength=len(hashes))
    gram_n = np.bincount(gram_at[np.repeat(train, sizes)], minlength=len(grams))
    return Round(ids, held, sizes, hashes[order], word_n, word_at, at, grams, gram_n, gram_at.astype(np.int32))


def asked(kept: DataFrame, n_slices: int) -> DataFrame:
    """As `counted`, of rounds: words and pairs of held-out rows too, with the counts of training rows, which may be 0."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = opened(batch.slice(k, 1))
                yield dealt(batch.column(0)[k].as_py(), r.words, r.word_n, r.grams, r.gram_n, n_slices)

    return kept.mapInArrow(ask, COUNTED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def answered(kept: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """SCORED for every row of the rounds, from the answers to them."""
    said = {"word_n": np.int64, "word_lev": np.uint8, "once_lev": np.uint8, "more_lev": np.uint8}

    def one(row: pa.RecordBatch, held: dict[str, list[bytes]]) -> pa.RecordBatch:
        r = opened(row)
        n, lev, once_lev, more_lev = (np.frombuffer(b"".join(held[c]), t) for c, t in said.items())
        once = r.gram_n == 1
        if (len(n), len(lev), len(once_lev), len(more_lev)) != (len(r.words), len(r.words), once.sum(), (~once).sum()):
            raise ValueError("answers are missing")
        gram_lev = np.empty(len(once), np.uint8)
        gram_lev[once], gram_lev[~once] = once_lev, more_lev
        own, before = r.word_at[r.tokens], r.word_at[r.tokens - 1]
        p = model.pair_log10(gram_lev[r.gram_at], lev[own]) - model.context_log10(lev)[before]
        first = np.cumsum(r.sizes) - r.sizes
        known, base = (n > 0).astype(np.int64)[own], np.log10(model.unigram(n))[own]
        return pa.RecordBatch.from_arrays([r.ids, r.held, pa.array(r.sizes), *(pa.array(np.add.reduceat(x, first)) for x in (known, base, p))], names=names_of(SCORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A round's own row comes before the answers to it, which come by slice."""
        now, row, held = None, None, {}
        for r, some in runs(batches):
            if r != now:
                if row is not None:
                    yield one(row, held)
                now, row, held, some = r, some.slice(0, 1), {c: [] for c in said}, some.slice(1)
            for c in said:
                held[c] += some.column(some.schema.get_field_index(c)).to_pylist()
        if row is not None:
            yield one(row, held)

    both = kept.withColumn("slice", F.lit(-1)).unionByName(answers.select("round", "slice", *said), allowMissingColumns=True)
    return both.repartition("round").sortWithinPartitions("round", "slice").mapInArrow(run, SCORED)


def learned(table: DataFrame, prior: float | None) -> Model:
    """The model of the counts of all slices."""
    by_level = table.where("round IS NULL").select(F.posexplode(F.arrays_zip("word_counts", "word_sums", "pair_counts", "pair_sums"))).groupBy("pos")
    sums = np.zeros((4, LEVELS))
    for r in by_level.agg(*(F.sum(f"col.{c}") for c in ("word_counts", "word_sums", "pair_counts", "pair_sums"))).collect():
        sums[:, r[0]] = r[1:]
    n, v = int(sums[1].sum()), int(sums[0].sum())
    values = np.divide(sums[1::2], sums[::2], out=np.zeros((2, LEVELS)), where=sums[::2] > 0)
    middle = STEP ** np.arange(0.0, LEVELS) * np.append(0, np.ones(LEVELS - 1))  # of levels that only false answers give
    values = np.where(values > 0, values, middle)
    return Model(n, v, learned_prior(n, sums[0], sums[1], int(sums[2][1])) if prior is None else prior, *values)


def score(docs: DataFrame, modulus: int = 10, max_bits: int = 1 << 30, broadcast_words: int = 8_000_000, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~learned_from(F.col("doc_id"), modulus)).alias("held_out"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = LEAST_SLICES
    while n_slices * SLICE_BYTES < n_bytes:
        n_slices *= 2

    def told(found: DataFrame, model: Model) -> DataFrame:
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")

    if n_bytes * 8 <= max_bits:
        table = stage(merged(counted(rows.where(~F.col("held_out")), n_slices), n_slices, answer=False), "slices")
        model, bits = learned(table, prior), table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
        if bits * 8 <= max_bits and model.v <= broadcast_words:
            return told(sent_scores(rows, table, n_slices, model), model)
    kept = stage(rounds(rows), "rounds", **ROUND_FILE)
    table = stage(merged(asked(kept, n_slices), n_slices, answer=True), "answers")
    model = learned(table, prior)
    return told(answered(kept, table.where("round IS NOT NULL"), model), model)


def sent_scores(rows: DataFrame, table: DataFrame, n_slices: int, model: Model) -> DataFrame:
    """SCORED for every row, by the whole filter in each worker."""
    sent = rows.sparkSession.sparkContext.broadcast((made_filter(table, n_slices), gathered(table.select("slice", "words", "word_n"), np.uint64, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, exact = sent.value
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                flat, sizes = flat_tokens(batch.column(1))
                at, grams = pairs(flat, sizes)
                words, back = np.unique(flat, return_inverse=True)
                i, has = looked_up(words, exact)
                n = np.where(has, exact[1][i] if len(exact[1]) else 0, 0)
                lev = filt.levels(words)
                own = np.log10(model.unigram(n))[back[at]]
                p = model.pair_log10(filt.levels(grams), lev[back[at]]) - model.context_log10(lev)[back[at - 1]]
                first = np.cumsum(sizes) - sizes
                known = np.add.reduceat((n > 0).astype(np.int64)[back[at]], first)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(known), pa.array(np.add.reduceat(own, first)), pa.array(np.add.reduceat(p, first))], names=names_of(SCORED))

    return rows.mapInArrow(run, SCORED)
