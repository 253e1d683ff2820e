"""Removal of long repeated byte strings by enhanced suffix arrays.

Finding what to sort: of every window of `length` bytes one gram is picked, the one of least hash, so
equal windows pick equal grams at equal places.  A run of windows with one gram is an occurrence of
it, with the bytes they span as its context.  Grams that occur once are dropped.  Where all contexts
of a gram are equal, or a context has copies, all its windows repeat.  The contexts that are left meet
per gram; their suffixes are sorted, and a stack scan over the common prefix lengths of neighbours
walks the tree of common-prefix intervals.  An interval whose members are preceded by different bytes
is a maximal repeat of its contexts.  `context_groups` returns these with all their occurrences, `repeated_spans`
what they cover; `groups.repeat_groups` joins them into the maximal repeats of the whole texts.  Grams with more than `bucket` different contexts are not sorted in one task: their windows'
hashes are counted instead, which finds the same windows.  Contexts are compared by 64-bit hashes.

Null text: empty.  Texts shorter than `length` are left alone.  Copies of a document, repeated rows
included, repeat as a whole.  A null id is an id of its own.  Empty table: no rows.  Other columns are
kept by `without_repeats` and ignored by `kept_digests`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import column_bytes, mix, signed, stage

LENGTH, GRAM, BUCKET = 200, 48, 2000
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)
CHUNK = 1 << 20
#: Of the most frequent grams (and contexts), how many are dealt over how many tasks each.
HOT, SALTS = 1000, 64


def gram_keys(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (32 + 16) bytes from each place on."""
    h = mix((buf.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    power, n, sixteen = BASE, 1, None
    while n < 32:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
        if n == 16:
            sixteen, by = h, power
    return mix(h[: len(buf) - GRAM + 1] * np.uint64(by) + sixteen[32 : 32 + len(buf) - GRAM + 1])


def occurrences(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one gram: which text, first and last window start in the text, gram hash,
    context hash.  The texts together are shorter than 2**24 bytes."""
    whole = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(whole) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    begins = np.cumsum(sizes) - sizes
    keys = gram_keys(np.frombuffer(whole, np.uint8))
    least = (keys & ~PLACE) | np.arange(len(keys), dtype=np.uint64)
    n, span = 1, length - GRAM + 1
    while 2 * n <= span:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    if n < span:
        least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
    at = (least & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    start = np.arange(len(at))
    good = start + length <= begins[text] + sizes[text]
    start, at, text = start[good], at[good], text[good]
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(start) != 1) | (np.diff(text) != 0)))
    last = np.append(first[1:], len(start)) - 1
    lo, hi, owner = start[first], start[last], text[first]
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(whole[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
    return owner, lo - begins[owner], hi - begins[owner], keys[at[first]], context


def groups_of(texts: list[bytes]) -> Iterator[list[int]]:
    """Consecutive texts that together fit a chunk."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > CHUNK:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


PIECE = 8 << 20


def found_in(docs: DataFrame, length: int) -> DataFrame:
    """gram, context, doc_id, text_key, lo, hi: the occurrences in every text."""
    schema = "gram long, context long, doc_id long, text_key long, lo long, hi long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            texts = column_bytes(batch, "text")
            for group in groups_of([t or b"" for t in texts]):
                # a text beyond PIECE bytes is searched in pieces that overlap by a window less one byte
                parts = [(i, a, texts[i][a : a + PIECE + length - 1]) for i in group if texts[i] for a in range(0, len(texts[i]), PIECE)]
                for k in range(0, len(parts), 1 if any(len(p[2]) > CHUNK for p in parts) else max(1, len(parts))):
                    some = parts[k : k + 1] if any(len(p[2]) > CHUNK for p in parts) else parts
                    owner, lo, hi, gram, context = occurrences([p[2] for p in some], length)
                    row = np.array([p[0] for p in some], np.int64)[owner]
                    shift = np.array([p[1] for p in some], np.int64)[owner]
                    yield pa.RecordBatch.from_arrays([signed(gram), signed(context), ids.take(pa.array(row)), pa.array(text_keys[row]), pa.array(lo + shift), pa.array(hi + shift)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text_key", "text").mapInArrow(scan, schema)


def suffix_array(texts: list[bytes], length: int, group: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """Of the suffixes of at least `length` bytes of all texts, in order: the text, the place in it, the bytes in common
    with the suffix before (0 for the first) and the byte before, which for a text's start is a number of its own.
    With `group`, a number for each text, the texts of a group are in order by themselves, one group after another.

    By prefix doubling: ranks by 4, 8, 16, ... bytes, an end standing before every byte; the bytes in common come
    from the same ranks, taken from the longest down."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    begin, stop = (np.repeat(x, sizes) for x in (np.cumsum(sizes) - sizes, np.cumsum(sizes)))
    at = np.arange(n)

    def ahead(rank: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return rank[np.where(places < ends, places, n)]

    h, ranks = 1, [np.append(buf + 1, 0)]
    longest = int(sizes.max(initial=0))
    while h < longest:
        pair = (ranks[-1][:n] << (9 * h if h < 4 else 32)) | ahead(ranks[-1], at + h, stop)
        h *= 2
        if h > 2:
            found, pair = np.unique(pair, return_inverse=True)
            pair = pair + 1
        ranks.append(np.append(pair, 0))
        if h > 2 and len(found) == n:
            break
    own = np.flatnonzero(stop - at >= length)
    of = np.repeat(np.zeros(len(texts), np.int64) if group is None else np.array(group, np.int64), sizes)
    own = own[np.lexsort((ranks[-1][own], of[own]))]
    x, y = own[:-1], own[1:]
    common = np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ahead(ranks[k], x + common, stop[x]) == ahead(ranks[k], y + common, stop[y])
        common += same << k
    common = np.where(of[x] == of[y], np.minimum(common, np.minimum(stop[x] - x, stop[y] - y)), 0)
    before = np.where(own > begin[own], buf[own - 1], -1 - np.arange(len(own)))
    text = np.repeat(np.arange(len(texts)), sizes)[own]
    return text, own - begin[own], np.append(np.zeros(min(1, len(own)), np.int64), common), before


def maximal_repeats(texts: list[bytes], length: int, group: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, place), ...]) of every maximal repeat of at least `length` bytes in the texts, or in those of each
    group."""
    text, place, common, before_ = suffix_array(texts, length, group)
    suffixes = list(zip(text.tolist(), place.tolist(), strict=True))
    lcp, left = [*common.tolist(), 0], before_.tolist()
    stack: list[list] = []  # of [common prefix, first suffix, byte before all of them or None if they differ]
    for i in range(1, len(lcp)):
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > lcp[i]:
            depth, first, same = stack.pop()
            before = same if same == before else None
            if before is None:
                yield depth, suffixes[first:i]
        if lcp[i] < length:
            continue
        if stack and stack[-1][0] == lcp[i]:
            if stack[-1][2] != before:
                stack[-1][2] = None
        else:
            stack.append([lcp[i], first, before])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def in_pieces(rows: DataFrame, keys: DataFrame, names: dict[str, str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with keys (columns of rows: columns of keys), of which the HOT with the most rows (`size`) are
    dealt over SALTS tasks each: what is sent to all workers is HOT rows, whatever the input."""
    columns = list(names.values())
    hot = keys.orderBy(F.desc(size), *columns).limit(HOT).select(*[F.col(c).alias(f"hot_{c}") for c in columns])
    hot = F.broadcast(hot)
    marked = rows.join(hot, [F.col(a) == F.col(f"hot_{b}") for a, b in names.items()], "left")
    is_hot = F.col(f"hot_{columns[0]}").isNotNull()
    dealt = marked.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "text_key", "lo"), F.lit(SALTS))).otherwise(F.lit(0)))
    spread = keys.join(hot, [F.col(b) == F.col(f"hot_{b}") for b in columns], "left")
    spread = spread.select(*keys.columns, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("dealt"))
    met = dealt.join(spread, [*(F.col(a) == F.col(b) for a, b in names.items()), F.col("salt") == F.col("dealt")], how)
    return met.select(*rows.columns, *([c for c in keys.columns if c not in (*columns, size)] if how == "inner" else []))


def contexts_of(docs: DataFrame, length: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The occurrences of grams that repeat, the different contexts of those that have several (one occurrence of each
    and how many there are), and the bytes of these."""
    everywhere = found_in(docs, length)
    several = everywhere.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1").select("g", "n", (F.col("c0") != F.col("c1")).alias("mixed"))
    repeated = stage(in_pieces(everywhere, stage(several, "grams"), {"gram": "g"}, "n"), "occurrences")
    mixed = repeated.where("mixed")
    place = F.struct("doc_id", "text_key", "lo", "hi")
    classes = stage(mixed.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(place).alias("at")), "classes")
    sizes = classes.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("contexts"))
    wanted = classes.join(sizes, F.col("gram") == F.col("g")).select(F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("k"), F.struct("gram", "context", "copies", (F.col("contexts") > bucket).alias("crowded"), "at.lo", "at.hi").alias("class"))
    # of one text, so no more than it has windows
    by_text = wanted.groupBy("d", "k").agg(F.collect_list("class").alias("classes"))
    texts = docs.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    CUT = "gram long, crowded boolean, context long, copies long, doc_id long, text_key long, lo long, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, text_key, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch, "text"), batch.column(3).to_pylist(), strict=True):
                for c in found:
                    out.append((c["gram"], c["crowded"], c["context"], c["copies"], doc_id, text_key, c["lo"], text[c["lo"] : c["hi"] + length]))
                if len(out) > 10_000:
                    yield rows(out, CUT)
                    out = []
            if out:
                yield rows(out, CUT)

    contexts = stage(texts.select("doc_id", "text_key", "text", "classes").mapInArrow(cut, CUT), "contexts")
    return repeated, classes, contexts


#: One occurrence of a context: gram, context, copies, doc_id, text_key, lo, bytes.
Member = tuple[int, int, int, int | None, int, int, bytes]


#: Bytes of contexts that share a suffix array, in which each gram's are in order by themselves.
TOGETHER = 1 << 16


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Member]]:
    """The contexts of whole grams, some grams at a time, from a partition sorted by gram."""
    held: list[Member] = []
    own: dict[int, Member] = {}
    gram, size = None, 0
    for batch in batches:
        for member in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)), strict=True):
            if member[0] != gram:
                held += own.values()
                if size > TOGETHER:
                    yield held
                    held, size = [], 0
                gram, own = member[0], {}
            own[member[1]] = member
            size += len(member[6])
    held += own.values()
    if held:
        yield held


def in_bulk(found: Iterator[tuple], schema: str, n: int = 10_000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in found:
        out.append(row)
        if len(out) == n:
            yield rows(out, schema)
            out = []
    if out:
        yield rows(out, schema)


def windows(contexts: DataFrame, length: int) -> DataFrame:
    """gram, window, copies, context, place, doc_id, text_key, start: each window of the crowded grams' contexts."""
    schema = "gram long, window long, copies long, context long, place long, doc_id long, text_key long, start long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, context, copies, doc_id, text_key, lo, ctx in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)), strict=True):
                n = len(ctx) - length + 1
                h = np.fromiter((xxhash.xxh3_64_intdigest(ctx[i : i + length]) for i in range(n)), np.uint64, n)
                same = [pa.array(np.full(n, v)) for v in (copies, context)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gram)), signed(h), *same, pa.array(np.arange(n)), pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, text_key)), pa.array(lo + np.arange(n))], names=[c.split()[0] for c in schema.split(", ")])

    return contexts.where("crowded").dropDuplicates(["gram", "context"]).mapInArrow(hashed, schema)


def by_gram(contexts: DataFrame) -> DataFrame:
    return contexts.where("not crowded").repartition("gram").sortWithinPartitions("gram")


def context_groups(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """gram, repeat, n_bytes, doc_id, text_key, start: every repeat (gram, repeat) that is maximal in the contexts of a
    gram (docs: doc_id, text_key, text), with all its occurrences, copies included.

    A repeat that is longer than a context is told as a chain of repeats that overlap.  Grams with over `bucket`
    contexts give repeats of `length` bytes."""
    repeated, classes, contexts = contexts_of(docs, length, bucket)
    GROUP = "gram long, context long, repeat long, n_bytes long, place long"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            for members in gathered(batches):
                n, whole = 0, set()
                for depth, places in maximal_repeats([m[6] for m in members], length, [m[0] for m in members]):
                    for k, p in places:
                        if depth == len(members[k][6]):
                            whole.add(k)
                        yield (*members[k][:2], n, depth, p)
                    n += 1
                for k, m in enumerate(members):
                    if m[2] > 1 and k not in whole:  # copies that no other context holds
                        yield (*m[:2], n, len(m[6]), 0)
                        n += 1

        yield from in_bulk(groups(), GROUP)

    tree = by_gram(contexts).mapInArrow(solve, GROUP)
    crowd = windows(contexts, length)
    twice = crowd.groupBy(F.col("gram").alias("g"), F.col("window").alias("w")).agg(F.sum("copies").alias("all")).where("all > 1").select("g", "w")
    counted = crowd.join(twice, (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w"))).select("gram", "context", F.col("window").alias("repeat"), F.lit(length).cast("long").alias("n_bytes"), "place")
    # of one context, so no more than its suffixes are in
    held = tree.unionByName(counted).groupBy("gram", "context").agg(F.collect_list(F.struct("repeat", "n_bytes", "place")).alias("held"))
    sized = held.join(classes.select("gram", "context", "copies"), ["gram", "context"]).withColumnsRenamed({"gram": "g", "context": "c"})
    met = in_pieces(repeated.where("mixed"), sized, {"gram": "g", "context": "c"}, "copies").withColumn("x", F.explode("held"))
    several = met.select("gram", "x.repeat", "x.n_bytes", "doc_id", "text_key", (F.col("lo") + F.col("x.place")).alias("start"))
    same = repeated.where("not mixed").select("gram", F.lit(0).cast("long").alias("repeat"), (F.col("hi") - F.col("lo") + length).alias("n_bytes"), "doc_id", "text_key", F.col("lo").alias("start"))
    return several.unionByName(same)


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_key, spans: of each text (docs: doc_id, text_key, text) the bytes that the repeats of
    `context_groups` cover, merged where they are found so that nested repeats are not shuffled."""
    repeated, classes, contexts = contexts_of(docs, length, bucket)
    SPAN = "doc_id long, text_key long, start long, stop long"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def covered() -> Iterator[tuple]:
            for members in gathered(batches):
                spans: list[list[tuple[int, int]]] = [[] for _ in members]
                for depth, places in maximal_repeats([m[6] for m in members], length, [m[0] for m in members]):
                    for k, p in places:
                        if members[k][2] == 1:  # copies are covered as a whole
                            spans[k].append((p, p + depth))
                for m, own in zip(members, spans, strict=True):
                    yield from ((m[3], m[4], m[5] + a, m[5] + b) for a, b in merged(own))

        yield from in_bulk(covered(), SPAN)

    sorted_ = by_gram(contexts).mapInArrow(solve, SPAN)
    crowd = windows(contexts, length)
    twice = crowd.groupBy(F.col("gram").alias("g"), F.col("window").alias("w")).count().where("count > 1").select("g", "w")
    counted = crowd.where("copies = 1").join(twice, (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w")), "left_semi").select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop"))

    mixed = repeated.where("mixed")
    whole = F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")
    copied = classes.where("copies > 1").select(F.col("gram").alias("g"), F.col("context").alias("c"), "copies")
    same = repeated.where("not mixed").select("doc_id", "text_key", *whole)
    copies = in_pieces(mixed, copied, {"gram": "g", "context": "c"}, "copies", "left_semi").select("doc_id", "text_key", *whole)
    spans = same.unionByName(copies).unionByName(sorted_).unionByName(counted)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))


def with_spans(docs: DataFrame, length: int, bucket: int) -> DataFrame:
    """Each row of docs (doc_id, text, rec) with its spans, null where nothing repeats."""
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = repeated_spans(keyed.select("doc_id", "text_key", "text"), length, bucket).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k", "text_key")


def kept_digests(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                cut = merged([(s["start"], s["stop"]) for s in spans or ()])
                kept = hashlib.sha256()
                for a, b in zip([0, *(s[1] for s in cut)], [*(s[0] for s in cut), len(text)], strict=True):
                    kept.update(text[a:b])
                for column, value in zip(out, (len(text), sum(b - a for a, b in cut), len(cut), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()], strict=True))], names=[c.split()[0] for c in schema.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(own, length, bucket).select("doc_id", "text", "spans").mapInArrow(digest, schema)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which give way to whole characters."""
    out, at = [], 0
    for a, b in merged(spans):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """The columns of docs (doc_id, text, ...) with repeated bytes taken out of the texts."""

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else without_spans(t, [(s["start"], s["stop"]) for s in spans or ()]) for t, spans in zip(column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rec", "text"])

    from pyspark.sql import types as T

    rec = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rec.alias("rec"))
    schema = T.StructType([own.schema["rec"], T.StructField("text", T.StringType())])
    done = with_spans(own, length, bucket).select("rec", "text", "spans").mapInArrow(take_out, schema)
    return done.select(*[F.col("text") if c == "text" else F.col("rec").getField(c).alias(c) for c in docs.columns])
