"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask such as 111101 selects words of a window and ignores the others.  The selected words of every
window of the benchmark items and of the documents are hashed, under each mask, and joined.  A hit
fixes an alignment of an item with a document; the words are then compared along it, and the document
is contaminated where at least `share` of the item's words stand at their places.  So passages are
found with any words replaced, up to that share, as long as one window agrees under one mask.

The hashes of the benchmark are sent to all workers while they are few (`sent_rows`), else the join
shuffles; the same holds for the alignments found.  Words are lower-cased.  Where an item has so few
words that replaced words allowed by the share can touch every window (none may be left whole), it is
looked for by a run of words that they cannot: of ceil(kept / (replaced + 1)) words.  Empty tables and null texts: no rows.  Null
ids: such documents and items are reported with a null id.  Repeated rows are reported once.  Other
columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import stage

MASKS = ("111101", "1101011", "10110011")
SENT_ROWS = 1_000_000


def word_codes(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def couples(codes: str) -> Column:
    """Hashes of each word with the next."""
    return F.transform(codes, lambda x, i: F.xxhash64(x, F.get(codes, i + 1)))


def seeds(codes: str, pairs: str, masks: tuple[str, ...]) -> Column:
    """Hashes of the windows under the first mask, then under the second, ...; two selected words that are
    neighbours are taken together from `pairs`."""

    def under(mask: str) -> Column:
        picked = [(m.start(), pairs if len(m[0]) == 2 else codes) for m in re.finditer("11?", mask)]
        hashed = F.transform(codes, lambda _, i: F.xxhash64(*[F.get(words, i + p) for p, words in picked]))
        return F.slice(hashed, 1, windows(F.size(codes), mask))

    return F.concat(*[under(m) for m in masks])


def windows(size: Column, mask: str) -> Column:
    return F.greatest(size - len(mask) + 1, F.lit(0))


def start_of(pos: Column, size: Column, masks: tuple[str, ...]) -> Column:
    before, out = F.lit(0), F.lit(None).cast("int")
    branches = []
    for mask in masks:
        branches.append((before, before + windows(size, mask)))
        before = before + windows(size, mask)
    for lo, hi in reversed(branches):
        out = F.when(pos < hi, pos - lo).otherwise(out)
    return out


def mask_of(pos: Column, size: Column, masks: tuple[str, ...]) -> Column:
    before, out = F.lit(0), F.lit(None).cast("string")
    branches = []
    for mask in masks:
        before = before + windows(size, mask)
        branches.append((before, mask))
    for hi, mask in reversed(branches):
        out = F.when(pos < hi, F.lit(mask)).otherwise(out)
    return out


def least_touching(most: int, masks: tuple[str, ...]) -> list[int]:
    """The least number of replaced words that touch every window of 0, 1, ..., `most` words."""
    span = max(len(m) for m in masks)
    states = np.arange(1 << span)  # the last `span` words, replaced or not; the latest is the lowest bit
    cost = np.where(states == 0, 0.0, np.inf)
    out = [0]
    for n in range(1, most + 1):
        half = len(cost) // 2
        before = np.minimum(cost[:half], cost[half:])  # forget the oldest
        cost = np.repeat(before, 2) + (states & 1)
        for m in masks:
            if len(m) <= n:
                cost[states & int(m, 2) == 0] = np.inf
        out.append(int(cost.min()))
    return out


def runs(sizes: list[int], share: float, masks: tuple[str, ...]) -> dict[int, str]:
    """For the sizes of items that the masks do not find surely, a mask that does."""
    touching, out = least_touching(max(sizes, default=0), masks), {}
    for n in sizes:
        kept = math.ceil(n * share - 1e-9)
        if touching[n] <= n - kept:
            out[n] = "1" * max(1, -(-kept // (n - kept + 1)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, masks: tuple[str, ...] = MASKS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, item_id, start (word of the document, may be negative), matched, item_words, by document and text."""
    return by_text(docs, benchmark, share, masks, sent_rows).drop("text_key")


def by_text(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, masks: tuple[str, ...] = MASKS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """As `contaminated`, with text_key, the hash of the text: rows that share an id but not the text are told apart."""
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_codes(F.col("text")).alias("item")).where("size(item) > 0").distinct(), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), word_codes(F.col("text")).alias("codes"))
    sizes = [r["n"] for r in items.select(F.size("item").alias("n")).distinct().collect()]
    short = runs(sizes, share, masks)
    first_masks, masks = masks, masks + tuple(sorted(set(short.values()) - set(masks)))
    item_seeds = items.withColumn("pairs", couples("item")).select(F.xxhash64("item_id", "item").alias("item_key"), F.size("item").alias("n"), F.posexplode(seeds("item", "pairs", masks)).alias("p", "seed"))
    if short:
        own_run = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
        under = mask_of(F.col("p"), F.col("n"), masks)
        item_seeds = item_seeds.where(under.isin(*first_masks) | F.coalesce(under == F.try_element_at(own_run, F.col("n")), F.lit(False)))
    item_seeds = item_seeds.select("item_key", "seed", start_of(F.col("p"), F.col("n"), masks).alias("item_at"))
    item_seeds = stage(item_seeds, "seeds")
    few = item_seeds.count() <= sent_rows
    own = texts.withColumn("pairs", couples("codes")).select("doc_id", "text_key", F.size("codes").alias("n"), F.posexplode(seeds("codes", "pairs", masks)).alias("p", "s"))
    hits = own.join(F.broadcast(item_seeds) if few else item_seeds, F.col("s") == F.col("seed"))
    shift = start_of(F.col("p"), F.col("n"), masks) - F.col("item_at")
    found = stage(hits.select("doc_id", "text_key", "item_key", shift.alias("start")).distinct(), "alignments")
    found = found.withColumnsRenamed({"doc_id": "d", "text_key": "k", "item_key": "i"})
    small = found.count() <= sent_rows
    aligned = texts.join(F.broadcast(found) if small else found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    keyed = items.withColumn("item_key", F.xxhash64("item_id", "item"))
    both = aligned.join(F.broadcast(keyed) if few else keyed, F.col("i") == F.col("item_key"))
    same = F.aggregate(F.transform("item", lambda x, j: F.when(F.get("codes", F.col("start") + j) == x, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    checked = both.select("doc_id", "text_key", "item_id", "start", same.alias("matched"), F.size("item").alias("item_words")).where(F.col("matched") >= F.ceil(F.col("item_words") * share - 1e-9))
    best = F.max(F.struct("matched", (-F.col("start")).alias("s"), "item_words")).alias("best")
    return checked.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", (-F.col("best.s")).cast("long").alias("start"), F.col("best.matched").cast("long").alias("matched"), F.col("best.item_words").cast("long").alias("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows whose text is not contaminated; others with the same id, or without one, stay."""
    bad = by_text(docs, benchmark, **how).select(F.col("doc_id").alias("bad"), F.col("text_key").alias("bad_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad"]) & (F.xxhash64(docs["text"]) == bad["bad_text"])
    return docs.join(bad, same, "left_anti")
