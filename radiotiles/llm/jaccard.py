"""N-gram Jaccard join with vertical partitioning.

The distinct shingles of a document are its set.  All shingles stand in one global order, rare before
frequent; frequencies come from a sketch of fixed size, since any order that is the same everywhere
gives right results.  The order is cut into fragments.  A pair's overlap is counted in each fragment
apart from the others, and the counts are summed per pair.

Pairs are looked for in the first fragment of each set only: a linked pair must share a shingle
among the rarest of both (as many as the threshold leaves over), at places that still allow the
overlap it needs.  A group of near copies is not spelled out as pairs: first each shingle's documents
are compared with one of them, the most typical; only documents that are still in different
components afterwards are compared with each other.  Texts with the same words are one node from the
start.

Sets are compared by 64-bit hashes of shingles, nodes by a 64-bit hash of the words.  Empty table: no
rows.  Null text or no word: an empty set, linked with nothing.  Repeated rows are copies.  A null id
takes part, but is never a component's id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import hashed_words, shingle_set, signed, slices, stage
from radiotiles.llm.components import components

SLOT_BITS = 22
CHUNKS = 1024
WIDTH = (1 << SLOT_BITS) // CHUNKS


def sets(batches: Iterator[pa.RecordBatch], n: int, wanted: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Of each text its place in the batch, its node (a hash of its words; None without words) and its
    sorted set; the set is empty for texts whose words came before in the task, or with `wanted`, for those
    whose place and node it does not want."""
    seen: set[int] = set()
    nothing = np.empty(0, np.uint64)
    for batch in batches:
        first = 0
        for part in slices(batch, "text"):
            words, at = hashed_words(part.column(part.schema.get_field_index("text")))
            for i in range(part.num_rows):
                own = words[at[i] : at[i + 1]]
                if not len(own):
                    yield first + i, None, nothing
                    continue
                node = xxhash.xxh3_64_intdigest(own.data)
                node -= (node >> 63) << 64
                if node in seen if wanted is None else not wanted(first + i, node):
                    yield first + i, node, nothing
                else:
                    seen.add(node)
                    yield first + i, node, shingle_set(own, n)
            first += part.num_rows


MEASURED = "doc_id long, text_key long, node long, n_shingles long, chunk int, counts binary"


def measured(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (doc_id, text_key, node, n_shingles), and for each task a sketch: how many
    shingles fall into each of 2**SLOT_BITS slots, in chunks (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes, now, out = np.zeros(1 << SLOT_BITS, np.int32), {}, None, ([], [])

        def told() -> pa.RecordBatch:
            k = len(out[0])
            return pa.RecordBatch.from_arrays([now.column(0), now.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)

        names = [c.split()[0] for c in MEASURED.split(", ")]
        for now in batches:
            out, held = ([], []), []
            for _, node, s in sets([now], n):
                if len(s):
                    sizes[node] = len(s)
                    held.append(s >> np.uint64(64 - SLOT_BITS))
                out[0].append(node)
                out[1].append(sizes.get(node, 0))
                if len(held) > 300:
                    np.add.at(total, np.concatenate(held).astype(np.int64), 1)
                    held = []
            if held:
                np.add.at(total, np.concatenate(held).astype(np.int64), 1)
            yield told()
        if total.any():
            parts = [r.tobytes() for r in np.minimum(total, 65535).astype(np.uint16).reshape(CHUNKS, WIDTH)]
            nulls = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(parts, pa.binary())], names=names)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, MEASURED)


def sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the sketches: 4 bytes a slot, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(b, np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((CHUNKS, WIDTH), np.int32)
    for r in parts.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():  # of fixed size
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def in_order(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order (frequency slot, then hash), and the frequencies."""
    f = counts[s >> np.uint64(64 - SLOT_BITS)]
    order = np.lexsort((s, f))
    return s[order], f[order]


def fragment_ends(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Frequencies at which the global order is cut, so that fragments hold about as many shingles."""
    f, weight = np.sort(counts), None
    weight = np.cumsum(f.astype(np.float64))
    if not len(f) or weight[-1] == 0:
        return np.zeros(fragments - 1, np.int64)
    return f[np.searchsorted(weight, weight[-1] * np.arange(1, fragments) / fragments)].astype(np.int64)


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of linked sets of a and b shingles."""
    return -(-num * (a + b) // (num + den))


TOKENS = "token long, node long, place long"
#: `place` packs what pairs are filtered by: the set's size, the shingle's position in it, and whether it is
#: within the shorter prefix that is enough for partners that are no smaller.
SIZE, POS, INDEXED = "shiftright({}.place, 32)", "(shiftright({}.place, 1) & 2147483647L)", "({}.place & 1L)"


def prefixes(docs: DataFrame, n: int, num: int, den: int, counts) -> DataFrame:
    """The first shingles of each set: as many as a linked partner cannot do without."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, node, s in sets(batches, n):
            size = len(s)
            if not size:
                continue
            probe = size - -(-num * size // den) + 1
            index = size - least_overlap(size, size, num, den) + 1
            s, _ = in_order(s, counts.value)
            held.append((s[:probe], node, size, index))
            rows += probe
            if rows > 200_000:
                yield told(held)
                held, rows = [], 0
        if held:
            yield told(held)

    def told(held: list) -> pa.RecordBatch:
        k = np.array([len(h[0]) for h in held])
        pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        node, size, index = (np.repeat(np.array([h[i] for h in held], np.int64), k) for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([signed(np.concatenate([h[0] for h in held])), pa.array(node), pa.array(size << 32 | pos << 1 | (pos < index))], names=["token", "node", "place"])

    return docs.select("text").mapInArrow(emit, TOKENS)


def may_link(x: str, y: str, num: int, den: int):
    """Whether sets that share a shingle at these places can be linked."""
    size, pos, indexed = ([F.expr(e.format(c)) for c in (x, y)] for e in (SIZE, POS, INDEXED))
    smaller_indexed = F.when(size[0] < size[1], indexed[0]).when(size[0] > size[1], indexed[1]).otherwise(F.least(*indexed)) == 1
    need = F.ceil((F.lit(num) * (size[0] + size[1])) / F.lit(float(num + den)) - 1e-9)
    return smaller_indexed & (den * F.least(*size) >= num * F.greatest(*size)) & (F.least(size[0] - pos[0], size[1] - pos[1]) >= need)


def overlaps(docs: DataFrame, measured: DataFrame, pairs: DataFrame, n: int, counts, ends: np.ndarray, sent_rows: int = 1_000_000) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of `pairs` (a, b): partial counts by fragment, summed per pair.  Up to
    `sent_rows` pairs and nodes (16 bytes each) are sent to all workers, more are joined by shuffle."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    # one document stands for a node
    nodes = stage(measured.join(nodes, F.col("node") == F.col("wanted")).groupBy("wanted").agg(F.min("doc_id").alias("stands")), "nodes")
    few, sent = nodes.count() <= sent_rows, None
    if few:
        t = nodes.orderBy("wanted").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((t.column(0).to_numpy(), t.column(1).to_pylist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        ids, stands = sent.value if sent else (None, None)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()

            def stands_for(i: int, node: int, doc_ids=doc_ids) -> bool:
                k = np.searchsorted(ids, node)
                return k < len(ids) and ids[k] == node and stands[k] == doc_ids[i]

            for i, node, s in sets([batch], n, stands_for if few else lambda *_: True):
                if not len(s):
                    continue
                s, f = in_order(s, counts.value)
                bounds = [0, *np.searchsorted(f, ends, side="right"), len(s)]
                for k in range(len(bounds) - 1):
                    if bounds[k] < bounds[k + 1] or k == 0:
                        held.append((doc_ids[i], node, k, len(s), np.sort(s[bounds[k] : bounds[k + 1]]).tobytes()))
                size += len(s)
                if size > 400_000:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    def told(held: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["doc_id", "node", "fragment", "size", "part"])

    parts = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, node long, fragment int, size int, part binary")
    if not few:
        parts = parts.join(nodes, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("stands")), "left_semi")
    parts = stage(parts, "fragments")
    small = few and pairs.count() <= sent_rows
    send = F.broadcast if small else lambda x: x
    left = parts.select(F.col("node").alias("na"), F.col("fragment").alias("fa"), F.col("size").alias("size_a"), F.col("part").alias("part_a"))
    right = parts.select(F.col("node").alias("nb"), F.col("fragment").alias("fb"), F.col("size").alias("size_b"), F.col("part").alias("part_b"))
    right = right.join(send(pairs.select(F.col("b").alias("c")).distinct()), F.col("nb") == F.col("c"), "left_semi")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) if x and y else 0 for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(both, pa.int32())], names=["a", "b", "fragment", "size_a", "size_b", "partial"])

    together = left.join(send(pairs), F.col("a") == F.col("na")).join(right, (F.col("b") == F.col("nb")) & (F.col("fa") == F.col("fb")))
    partial = together.select("a", "b", F.col("fa").alias("fragment"), "size_a", "size_b", "part_a", "part_b").mapInArrow(shared, "a long, b long, fragment int, size_a int, size_b int, partial int")
    # repeated rows give a fragment's count more than once
    once = partial.groupBy("a", "b", "fragment").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.max("partial").alias("partial"))
    return once.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("partial").alias("overlap"))


def links(docs: DataFrame, measured: DataFrame, table: np.ndarray, n: int, num: int, den: int, fragments: int = 4) -> DataFrame:
    """(node, root): the components that the linked pairs make of the nodes; table: the sketch."""
    spark = docs.sparkSession
    ends = fragment_ends(table, fragments)
    counts = spark.sparkContext.broadcast(table)
    tokens = stage(prefixes(docs, n, num, den, counts), "prefixes")
    # shingles of at least two nodes, of which at least one is indexed
    common = tokens.groupBy(F.col("token").alias("t")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.expr("place & 1L")).alias("any")).where("lo <> hi and any = 1").select("t")
    shared = stage(tokens.join(common, F.col("token") == F.col("t"), "left_semi"), "shared")

    def linked(pairs: DataFrame) -> DataFrame:
        counted = overlaps(docs, measured, pairs, n, counts, ends)
        return counted.where(f"{den} * overlap >= {num} * (size_a + size_b - overlap)").select("a", "b")

    # the most typical document of a shingle is the one with the fewest rarer shingles
    member = F.struct("node", "place")
    leader = shared.groupBy(F.col("token").alias("t")).agg(F.min(F.struct(F.expr("shiftright(place, 1) & 2147483647L").alias("rarer"), "node", "place")).alias("y"))
    stars = shared.select("token", member.alias("x")).join(leader, F.col("token") == F.col("t")).where((F.col("x.node") != F.col("y.node")) & may_link("x", "y", num, den))
    first = stage(stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "stars")
    edges = stage(linked(first), "links")
    found = components(edges)

    rooted = shared.join(found.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("token", F.coalesce("root", "node").alias("root"), member.alias("x"))
    mixed = rooted.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t")
    rest = stage(rooted.join(mixed, F.col("token") == F.col("t"), "left_semi"), "rest")
    other = rest.select(F.col("token").alias("t"), F.col("root").alias("r"), F.col("x").alias("y"))
    across = rest.join(other, (F.col("token") == F.col("t")) & (F.col("root") < F.col("r")) & may_link("x", "y", num, den))
    second = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    seen = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = stage(second.join(seen, ["a", "b"], "left_anti"), "pairs")
    return components(edges.unionByName(linked(second)))


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id (the least doc_id reachable) of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    both = stage(measured(own, n), "measured")
    roots = links(own, both.where("chunk is null").select("doc_id", "node"), sketch(both), n, num, den)
    rooted = both.where("chunk is null").join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("doc_id", "text_key", "n_shingles", F.coalesce("root", "node").alias("root"))
    least = rooted.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    return rooted.join(least, F.col("root") == F.col("r"), "left").select("doc_id", "text_key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def component_ids(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return classes(docs, n, num, den).drop("text_key")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is their component's; of repeated rows, one.  Rows without an id stay
    unless they are linked with one that has an id."""
    found = stage(classes(docs, n, num, den), "components")
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"]) == gone["k"]), "left_anti")
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
