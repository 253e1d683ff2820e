"""Decontamination, repeats, the Jaccard join and the pipeline against SQL and brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from radiotiles.llm import contamination, groups, jaccard, queries, repeats
from radiotiles.llm.common import stage
from radiotiles.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, token long, node long, d long, k long, spans string, start int, item_id long, rec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, "x", 5, 6, "r") for i, t in rows], ODD)


def some_words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    base = some_words(1, 120)
    near = base.copy()
    near[60] = "other"
    long = " ".join(some_words(2, 40_000, 10**6))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, " ".join(base)), (7, " ".join(base).upper()), (8, " ".join(near)), (9, long), (10, long + " end"), (None, " ".join(base)), (11, "É x " * 90), (11, "É x " * 90)]
    return rows


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_warc_revisits", "op7_suffix_dedup", "op8_ngram_jaccard"])
def test_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, data).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(cur.fetchall())


def covered_brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cov = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cov[i : i + length] = b"\1" * length
        out.append(cov)
    return out


def digests_brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (i, _), t, cov in zip(rows, texts, covered_brute(texts, length), strict=True):
        runs = sum(1 for k in range(len(cov)) if cov[k] and not (k and cov[k - 1]))
        out[i, len(t), sum(cov), runs, hashlib.sha256(bytes(b for b, c in zip(t, cov, strict=True) if not c)).hexdigest()] += 1
    return out


def repeat_rows():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (150, 260, 400)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("xyzü ") for _ in range(rng.randrange(0, 300))) for _ in range(3)]
        rows.append((i, passages[i % 3].join(parts) if i % 4 else parts[0]))
    return [*rows, (60, "ab" * 400), (61, "q" * 700), (62, rows[1][1]), *[(i, t) for i, t in odd_rows() if t is None or len(t) < 5000]]


@pytest.mark.parametrize("bucket", [2000, 3])
def test_repeats_agree_with_brute_force(spark, bucket):
    rows = repeat_rows()
    got = Counter(map(tuple, repeats.kept_digests(frame(spark, rows), bucket=bucket).collect()))
    assert got == digests_brute(rows, repeats.LENGTH)
    assert repeats.kept_digests(frame(spark, []), bucket=bucket).count() == 0


def maximal_brute(texts, length):
    """String: (row, start) of all occurrences, of the strings that some pair of places has in common, no longer to
    either side."""
    windows = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            windows.setdefault(t[i : i + length], []).append((k, i))
    found = set()
    for places in windows.values():
        for (k, i), (m, j) in itertools.combinations(places, 2):
            if i and j and texts[k][i - 1] == texts[m][j - 1]:
                continue
            n = length
            while i + n < len(texts[k]) and j + n < len(texts[m]) and texts[k][i + n] == texts[m][j + n]:
                n += 1
            found.add(texts[k][i : i + n])
    return {w: Counter(p for p in windows[w[:length]] if texts[p[0]].startswith(w, p[1])) for w in found}


def told_groups(spark, rows, bucket):
    docs = frame(spark, rows).withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text")
    out = {}
    for r in groups.repeat_groups(docs, bucket=bucket).collect():
        out.setdefault((r["repeat"], r["n_bytes"]), []).append((r["doc_id"], r["start"]))
    return out


@pytest.mark.parametrize("bucket", [2000, 1])
def test_repeat_groups_are_the_maximal_repeats(spark, bucket):
    rng = random.Random(8)
    nested = ["".join(rng.choice("abcde") for _ in range(n)) for n in (90, 700, 230, 1500, 160)]
    mixed = ["".join(rng.choice([*nested, "-", "+", ";;"]) for _ in range(9)) for _ in range(8)]
    rows = [(i, t) for i, t in repeat_rows() if i is not None and (t is None or len(t) < 3000)]
    rows = [*rows, *((100 + i, t) for i, t in enumerate(mixed)), (120, mixed[0]), (120, mixed[0])]
    texts = [(t or "").encode() for _, t in rows]
    want = {}
    for w, places in maximal_brute(texts, repeats.LENGTH).items():
        want[w] = sorted((rows[k][0], i) for k, i in places)
    of = {}
    for (i, _), t in zip(rows, texts, strict=True):
        of.setdefault(i, []).append(t)
    got = {}
    for (_, n), places in told_groups(spark, rows, bucket).items():
        ((i, a), *_) = places
        (said,) = {t[a : a + n] for t in of[i] if len(t) >= a + n and t[a : a + n] in want} or {None}
        assert said not in got
        got[said] = sorted(places)
    assert got == want
    assert max(map(len, got)) > 2000


def test_suffix_array_against_sorted_slices():
    rng = random.Random(4)
    for case in range(300):
        n, letters = rng.randrange(1, 40), b"ab\x00\xff"[: rng.randrange(1, 5)]
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(0, n))) for _ in range(rng.randrange(0, 6))]
        length = rng.randrange(1, 6)
        text, place, common, before = (x.tolist() for x in repeats.suffix_array(texts, length))
        told = [texts[k][i:] for k, i in zip(text, place, strict=True)]
        assert told == sorted(t[i:] for t in texts for i in range(len(t) - length + 1)), case
        assert sorted(zip(text, place, strict=True)) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]
        prefix = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert common == [0, *(prefix(a, b) for a, b in itertools.pairwise(told))][: len(told)]
        group = [rng.randrange(3) for _ in texts]
        alone = [sorted((d, tuple(sorted((at[k], i) for k, i in found))) for d, found in repeats.maximal_repeats([texts[k] for k in at], length)) for at in ([k for k, g in enumerate(group) if g == own] for own in range(3))]
        assert sorted(itertools.chain(*alone)) == sorted((d, tuple(sorted(found))) for d, found in repeats.maximal_repeats(texts, length, group)), case
        assert len({b for b in before if b < 0}) == place.count(0) and all(b == texts[k][i - 1] for k, i, b in zip(text, place, before, strict=True) if i)


def test_a_long_repeat_and_its_part_are_two_groups(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(3000)
    rows = [(1, text(500) + passage + text(400)), (2, text(90) + passage), (3, text(300) + passage[1000:1600] + text(10)), (4, None), (5, text(900))]
    starts = {i: (t or "").find(passage[1000:1600]) for i, t in rows}
    got = {n: sorted(places) for (_, n), places in told_groups(spark, rows, 2000).items()}
    longest = [n for n in got if n >= 3000]
    assert len(got) == 2 and [len(got[n]) for n in sorted(got)] == [3, 2] and longest
    assert [i for i, _ in got[longest[0]]] == [1, 2]
    assert all(abs(a - starts[i]) < 5 for i, a in got[min(got)])
    assert told_groups(spark, [], 2000) == {}


def test_groups_cover_what_is_removed(spark):
    rows = list(dict((i, t) for i, t in repeat_rows() if i is not None).items())
    covered = {i: set() for i, _ in rows}
    for (_, n), places in told_groups(spark, rows, 2000).items():
        for i, a in places:
            covered[i].update(range(a, a + n))
    removed = {r["doc_id"]: r["n_removed"] for r in repeats.kept_digests(frame(spark, rows)).collect()}
    assert {i: len(c) for i, c in covered.items()} == removed


def test_maximal_repeats():
    texts = [b"xabcdey", b"zabcdew", b"qabcdr", b"abcd"]
    found = {(d, tuple(sorted(p))) for d, p in repeats.maximal_repeats(texts, 3)}
    assert (5, ((0, 1), (1, 1))) in found and (4, ((0, 1), (1, 1), (2, 1), (3, 0))) in found
    assert not any(d == 3 for d, _ in found)  # bcd is always preceded by a


def test_without_repeats_keeps_characters_and_columns(spark):
    rows = repeat_rows()
    out = repeats.without_repeats(frame(spark, rows))
    assert out.columns == frame(spark, []).columns and out.count() == len(rows)
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, t), own, cov in zip(rows, texts, covered_brute(texts, repeats.LENGTH), strict=True):
        # a removed run gives way to the characters of which it holds a part only
        cut = list(cov)
        for k in range(len(own)):
            if own[k] & 0xC0 != 0x80:
                end = next((m for m in range(k + 1, len(own)) if own[m] & 0xC0 != 0x80), len(own))
                if not all(cov[k:end]):
                    cut[k:end] = [0] * (end - k)
        want[i, None if t is None else bytes(b for b, c in zip(own, cut, strict=True) if not c).decode()] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def components_brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").encode().lower())
        sets.append({tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i), d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard_near_copies(spark, n, num):
    rng = random.Random(n)
    rows, passage = [], some_words(99, 30)
    for b in range(6):
        base = some_words(100 + b, rng.choice([8, 40, 150]))
        for c in range(25):
            w = base.copy()
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
            rows.append((1000 * b + c, " ".join(w)))
    rows += [(i + 20_000 - 2 * (i % 1000), t) for i, t in rows[::3]]  # copies, not in order of id
    rows += [(9000 + i, " ".join(passage + some_words(500 + i, 10 + i))) for i in range(40)] + odd_rows()
    random.Random(3).shuffle(rows)
    got = Counter(map(tuple, jaccard.component_ids(frame(spark, rows), n, num, 100).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == components_brute(rows, n, num, 100)
    assert jaccard.component_ids(frame(spark, []), n, num, 100).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1000, 1002)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 0), 1001: 1000, 1002: 1000}


def test_one_of_each(spark):
    kept = [r["doc_id"] for r in jaccard.one_of_each(frame(spark, odd_rows())).collect()]
    assert Counter(kept) == Counter([1, 2, 3, 4, 6, 9, 11])


def test_contamination_with_substitutions(spark):
    item = some_words(7, 30)
    changed = item.copy()
    for i in range(4, 30, 5):
        changed[i] = "subst"
    lost = changed.copy()
    lost[0] = lost[10] = "subst"
    around = lambda w, s: " ".join(some_words(s, 20) + w + some_words(s + 1, 20))
    docs = frame(spark, [(1, around(item, 50)), (2, around(changed, 60)), (3, around(lost, 70)), (4, around([], 80)), (5, None), (6, ""), (None, around(item, 90)), (8, "w " * 30_000), (1, around(item, 50))])
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (None, " ".join(some_words(8, 9)), 0)], "item_id long, text string, doc_id int")
    for sent in (1_000_000, 0):
        got = {(r["doc_id"], r["item_id"], r["matched"]) for r in contamination.contaminated(docs, bench, sent_rows=sent).collect()}
        assert got == {(1, 1, 30), (2, 1, 24), (None, 1, 30)}
    assert sorted(r["doc_id"] for r in contamination.decontaminate(docs, bench).collect()) == [3, 4, 5, 6, 8]
    assert contamination.contaminated(docs.where("false"), bench).count() == 0
    assert contamination.contaminated(docs, bench.where("false")).count() == 0


def test_short_items_are_found_under_every_pattern(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 13)}
    rows, want = [], set()
    for n, item in items.items():
        allowed = n - math.ceil(n * 0.8 - 1e-9)
        for k in range(allowed + 2):
            for places in itertools.combinations(range(n), k):
                text = [f"x{j}" if j in places else w for j, w in enumerate(item)]
                rows.append((len(rows), " ".join(["a", "b", *text, "c"])))
                if k <= allowed:
                    want.add((rows[-1][0], n, 2, n - k, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    for sent in (1_000_000, 0):
        got = contamination.contaminated(frame(spark, rows), bench, sent_rows=sent).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_least_touching_agrees_with_enumeration():
    got = contamination.least_touching(14, contamination.MASKS)
    for n in range(15):
        windows = [sum(1 << (a + j) for j, c in enumerate(m) if c == "1") for m in contamination.MASKS for a in range(n - len(m) + 1)]
        assert got[n] == min(s.bit_count() for s in range(1 << n) if all(s & w for w in windows))


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "ngram_jaccard":
            want = {c for _, _, c in components_brute(rows, 5, 80, 100)}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "suffix_dedup":
            cut = {i: bytes(b for b, c in zip(t.encode(), cov, strict=True) if not c).decode(errors="ignore") for (i, t), cov in zip(rows, covered_brute([t.encode() for _, t in rows], 200), strict=True)}
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {i for i, t in cut.items() if t.strip()} == set(got)
            assert all(abs(len(got[i]) - len(cut[i])) <= 4 for i in got)
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == before.count()
    # all ids of all documents that packing got, each once
    pieces = docs.select("doc_id", "start", "length", "doc_tokens").collect()
    whole = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(whole.values())
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == n for i, n in list(whole.items())[:20])


def test_decontamination_tells_rows_of_one_id_apart(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(None, f"x {item} y", 1), (None, "clean text here", 2), (5, item, 3), (5, "other clean text", 4), (6, None, 5)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted(r["n"] for r in contamination.decontaminate(docs, bench).collect()) == [2, 4, 5]
    assert contamination.decontaminate(docs.where("false"), bench).count() == 0


def test_repeat_stage_keeps_blank_rows_and_needs_no_count_column(spark):
    import corpus_pipeline

    long = "".join(f"word{i} " for i in range(60))
    docs = spark.createDataFrame([(1, long, -1), (2, long, 7), (3, " \n", -1), (4, None, None), (5, "short", 5)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: r["n_chars"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()} == {3: 2, 4: None, 5: 5}
    assert {r["doc_id"] for r in corpus_pipeline.cut_repeats(spark, docs.drop("n_chars"), "").collect()} == {3, 4, 5}


def test_stages_on_empty_tables(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    some = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40)
    for docs in (some.where("false"), some):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            if docs is not some:
                assert out.count() == 0
            elif name in ("toxicity", "decontamination"):  # nothing learned and nothing to look for
                assert out.count() == 40
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_further_columns_of_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(some_words(2, 40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, odd_rows())
    names = {"token": "bad", "node": "bad_text", "d": "gone", "k": "text_key", "spans": "codes", "start": "component_id", "item_id": "predicted"}
    for docs in (docs, docs.withColumnsRenamed(names)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and all(r["rec"] == "r" for r in rows)
