"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  The target share of a source in every window is its share of all
tokens, so all queues run dry together and nothing is left over.  The queues are cut into parts of
`part_windows` windows; part j takes from queue s the tokens from B(s, j) to B(s, j+1) with

    B(s, j) = floor(C(s) * j) - floor(C(s-1) * j),   C(s) = tokens of a part * share of sources up to s

so each part holds exactly its number of tokens, and what a source is owed beyond whole tokens (its
deficit) is carried into the next part.  Inside a part, sources earn their share of each window, the
source owed most is served first, in pieces of at least `quantum` tokens, and what is overdrawn or
owed is carried to the next window.  Documents are cut where a window or a part ends.  Parts are
independent of each other: one group holds `part_windows` windows, however large a source is.  Sources
of under `quantum` tokens a part share one queue.

Empty table: no rows.  Null text: empty, so the document is its end token alone.  A null source is a
queue of its own.  Repeated rows are packed as often as they occur, ties and order are those of the
input partitions.  Texts of any length are coded whole and cut where windows and parts end.  Other
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.llm.common import slices, stage

END_ID = 0
SENT_ROWS = 200_000
SMALL = "\x00small"


def default_vocabulary() -> str:
    """Place of the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """The ids that the `tokenizers` library gives with a byte-level BPE file, for many texts at once.

    A space before a character that is no white space always begins a new word of the tokenizer, so texts
    are cut there, and each distinct piece of a batch is coded once; ids of pieces met before are kept.  Texts
    with wider white space are coded whole.  Texts that hold an added token of the file go to the library
    itself, and so does all where the file is not a plain byte-level BPE."""

    LIMIT = 150_000

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import pre_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.added = [t["content"] for t in form["added_tokens"]]
        self.top = max(form["model"]["vocab"].values(), default=0)
        cut, model = form["pre_tokenizer"] or {}, form["model"]
        self.plain = (
            (cut.get("type"), cut.get("use_regex", True), cut.get("add_prefix_space"), form["normalizer"], form["post_processor"]) == ("ByteLevel", True, False, None, None)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        if self.plain:
            # the file writes each byte as a printable character; printable bytes stand for themselves
            letters = sorted(pre_tokenizers.ByteLevel.alphabet())
            own = [c for c in letters if ord(c) < 256]
            of = {c: ord(c) for c in own} | dict(zip([c for c in letters if ord(c) > 255], sorted(set(range(256)) - {ord(c) for c in own}), strict=True))
            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        """Forget the pieces: their numbers, and by number the place and count of their ids in `flat`."""
        self.known: dict[str, int] = {"": 0}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        if self.plain and not any(t in text for t in self.added):
            return self.encode(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def add(self, coded: list[list[int]]) -> None:
        """Number some more ids, from the numbers given so far on."""
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        more = np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(size.sum()))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.flat, self.size = np.append(self.flat, more), np.append(self.size, size)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.add([self.encode(p) for p in new])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has.  Null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.plain:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.known) > self.LIMIT:
            self.clear()
        cut = pc.split_pattern(texts, " ")
        edges = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        edges, words, index = edges - edges[0], coded.dictionary, coded.indices.to_numpy()
        special = np.zeros(len(words), bool)
        for t in self.added:
            special |= pc.match_substring(words, t).to_numpy(zero_copy_only=False)
        spaced = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False) | special
        first = edges[:-1]
        odd = spaced[index]
        odd[first] = special[index[first]]
        wide = np.logical_or.reduceat(odd, first)
        number = self.numbers(pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type)).to_pylist())[index]
        number[first] = self.numbers(words.take(pa.array(index[first])).to_pylist())
        kept = len(self.size), len(self.flat)
        for k, i in enumerate(np.flatnonzero(wide).tolist()):
            number[edges[i] : edges[i + 1]] = 0  # no ids
            number[first[i]] = kept[0] + k
        self.add([self.whole(texts[i].as_py()) for i in np.flatnonzero(wide).tolist()])
        n = self.size[number]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.start[number] - (ends - n), n) + np.arange(ends[-1])]
        # texts coded whole are not kept
        self.start, self.size, self.flat = self.start[: kept[0]], self.size[: kept[0]], self.flat[: kept[1]]
        return out, np.add.reduceat(n, first)


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, part and at (which input partition, tokens of the source before in it), ids as
    binary (16 bits each where the vocabulary allows), with the end token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, before = ByteBpe(vocabulary or default_vocabulary()), {}  # for this task only: workers live on, and so would its memory
        kind = np.uint16 if bpe.top < 1 << 16 else np.uint32
        for whole_batch in batches:
            for batch in slices(whole_batch, "text", 6 << 20):
                flat, n = bpe.ids(batch.column("text"))
                ends = np.cumsum(n + 1)
                ids = np.full(int(ends[-1]), END_ID, kind)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = flat
                at = []
                for source, k in zip(batch.column("source").to_pylist(), (n + 1).tolist(), strict=True):
                    at.append(before.get(source, 0))
                    before[source] = at[-1] + k
                offsets = np.append(0, ends * ids.itemsize)
                binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(at, pa.int64()), pa.array(n + 1), binary], names=["doc_id", "source", "part", "at", "n", "ids"])
            pa.default_memory_pool().release_unused()  # the worker lives on, beside others

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(encode, "doc_id long, source string, part int, at long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = 1024, part_windows: int = 2048, quantum: int = 128, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document in a window: doc_id, start, length, ids (little-endian
    32-bit), doc_tokens, sequence_id, offset.  Only the very last window may need padding."""
    tokens = stage(tokenized(docs, vocabulary), "tokens")
    shares = stage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "shares")
    sizes = shares.groupBy("source").agg(F.sum("n").alias("n"))
    told = sizes.agg(F.sum("n")).first()[0] or 0
    # sources of under `quantum` tokens a part share a queue, so there are at most window * part_windows / quantum + 1 queues
    sizes = sizes.withColumn("queue", F.when(F.col("n") * (window * part_windows) < quantum * told, F.lit(SMALL)).otherwise(F.col("source")))
    mixture = sorted(((r["queue"], r["n"]) for r in sizes.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0]))
    of = sizes.select(F.col("source").alias("s"), "queue")
    queues = shares.join(of, F.col("source").eqNullSafe(F.col("s"))).select("source", "part", "queue", "n")
    # tokens before: in a queue by input partition, and in a partition's share of the queue by source
    in_part = Window.partitionBy("queue", "part").orderBy("source")
    parts = queues.groupBy("queue", "part").agg(F.sum("n").alias("all"))
    parts = parts.select(F.col("queue").alias("q"), F.col("part").alias("p"), (F.sum("all").over(Window.partitionBy("queue").orderBy("part")) - F.col("all")).alias("lower"))
    before = queues.withColumn("inner", F.sum("n").over(in_part) - F.col("n")).join(parts, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))
    before = before.withColumn("base", F.col("lower") + F.col("inner")).drop("q", "p")
    ends = np.cumsum([n for _, n in mixture], dtype=object) if mixture else []
    total = int(ends[-1]) if mixture else 0
    span = {s: (int(e) - n, int(e)) for (s, n), e in zip(mixture, ends, strict=True)}
    per_part = window * part_windows

    def cut(source: str | None, j: int) -> int:
        """B(source, j); beyond the last part, all tokens."""
        lo, hi = span[source]
        done = min(per_part * j, total)
        return hi * done // total - lo * done // total

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts documents where parts end."""
        for batch in batches:
            out = []
            for doc_id, source, first, n, ids in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source", "first", "n", "ids")), strict=True):
                width, lo, hi = len(ids) // n, *span[source]
                j, at = max(0, first * total // ((hi - lo) * per_part) - 1), 0
                while at < n:
                    while cut(source, j + 1) <= first + at:
                        j += 1
                    to = min(n, cut(source, j + 1) - first)
                    out.append((j, source, first + at, doc_id, at, n, ids[at * width : to * width], width))
                    at = to
                    if len(out) >= 2000:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    names, types = ["j", "source", "queued", "doc_id", "start", "doc_tokens", "ids", "width"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def serve(group: pa.Table) -> pa.Table:
        """Deficit round-robin over the queues of one part."""
        group = group.sort_by([("source", "ascending"), ("queued", "ascending")])
        j, doc_id, start, doc_tokens, ids, width = (group.column(k).to_pylist() for k in ("j", "doc_id", "start", "doc_tokens", "ids", "width"))
        source = group.column("source").to_pylist()
        queues: dict[str | None, list[int]] = {}
        for i in range(len(source) - 1, -1, -1):
            queues.setdefault(source[i], []).append(i)
        size = {s: sum(len(ids[i]) // width[i] for i in q) for s, q in queues.items()}
        whole, first = sum(size.values()), j[0] * part_windows
        order = sorted(queues, key=lambda s: (s is not None, s))
        earn = np.array([window * size[s] / whole for s in order])
        owed, out, k, room = earn.copy(), [], 0, window  # of empty queues: minus infinity
        done = [0] * len(source)
        while queues:
            q = int(owed.argmax())
            s = order[q]
            turn = min(room, max(quantum, int(owed[q])))
            while turn and s in queues:
                i = queues[s][-1]
                n, w = len(ids[i]) // width[i], width[i]
                take = min(turn, n - done[i])
                out.append((doc_id[i], start[i] + done[i], take, np.frombuffer(ids[i], f"<u{w}")[done[i] : done[i] + take].astype("<u4").tobytes(), doc_tokens[i], first + k, window - room))
                done[i] += take
                turn, room, owed[q] = turn - take, room - take, owed[q] - take
                if done[i] == n:
                    queues[s].pop()
                    if not queues[s]:
                        del queues[s]
                        owed[q] = -np.inf
            if not room:
                k, room = k + 1, window
                owed += earn
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    bases = before.select("queue", "base", F.col("source").alias("s"), F.col("part").alias("p"))
    # a row for each source in each input partition: sent to all while that is small, joined by shuffle beyond
    if shares.count() <= SENT_ROWS:
        bases = F.broadcast(bases)
    queued = tokens.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    parts = queued.select("doc_id", F.col("queue").alias("source"), (F.col("base") + F.col("at")).alias("first"), "n", "ids").mapInArrow(spread, "j long, source string, queued long, doc_id long, start long, doc_tokens long, ids binary, width int")
    return parts.groupBy("j").applyInArrow(serve, PIECES)


def piece_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (unsigned) in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
