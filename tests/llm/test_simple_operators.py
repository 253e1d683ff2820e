"""Quality rules, sharding, chat formatting, LM scoring, revisits, toxicity and packing against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from radiotiles.llm import chat, lm, packing, quality, queries, sharding, toxicity, warc
from radiotiles.llm.common import hashed_words

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "x", None),
    (2, "", None, "en"),
    (3, " \n\t ", "x", "en"),
    (4, "one", "y", "en"),
    (5, "a b c a b c a b c", "x", "en"),
    (6, "line one\nline one\n\nline one\n two", "x", "en"),
    (7, "É x # | <|im_end|>   \x1c y\x0bz", "x", "en"),
    (7, "É x # | <|im_end|>   \x1c y\x0bz", "x", "en"),
    (8, "w " * 30000, "x", "en"),
    (None, "no id here", "x", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, source string, lang string, rec int, rank int, slot string, bucket int, n_words int, part int, at int, held_out int"
    return spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5, 6, 7) for r in ODD], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def base_numbers(text):
    words = [w.decode() for w in WORDS.findall(text.encode())]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x.encode())]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_numbers(spark, data, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = texts(spark, data)
    got = queries.op1_quality_rules(spark, data).collect()
    assert len(got) == len(want)
    for r in got:
        expected = base_numbers(want[r["doc_id"]])
        assert tuple(r[k] for k in names) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["base_failed"] and r["kept"])
    found = {(r["doc_id"], tuple(r[k] for k in names)) for r in quality.statistics(odd).collect()}
    assert found == {(i, base_numbers(t or "")) for i, t, *_ in ODD}


def test_quality_rules_learn_on_held_out(spark):
    rows = [(i, int(i % 3 != 0), float(i % 3 == 0) * 0.5 + (i % 7) / 100) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, quality int, x double")
    labelled = frame.select("doc_id", "quality", *[(F.col("x") * 1000 if k == "n_symbols" else F.lit(1000)).cast("long").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_distinct_words", "n_bangs", "n_digits")])
    rules = quality.learn(labelled)
    assert rules and rules[0].conditions[0].feature == "symbol_share"
    wrong = labelled.select(F.struct("*").alias("r"), *quality.features()).where((quality.rule_number(rules) > 0) != (F.col("r.quality") == 0)).count()
    assert wrong == 0


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 0), (2, 0, None), (None, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd, labels).count() == len(ODD)
    assert quality.judge(none, labels.where("false")).count() == 0


def test_shards(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.assign_shards(docs, 24, bucket_bytes=40_000).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts(spark, data)))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["text"] == texts(spark, data)[r["doc_id"]] if r["doc_id"] < 5 else True
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.assign_shards(docs.repartition(7), 24, bucket_bytes=40_000).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    out = sharding.assign_shards(odd, 4)
    assert out.count() == len(ODD) and out.dtypes[-1] == ("slot", "bigint")
    assert sharding.assign_shards(none, 4).count() == 0


def test_shard_files(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sharding.write_shards(sharding.assign_shards(docs, 3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_fisher_yates_is_uniform():
    first = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(first) == 6 and max(first.values()) < 1200


def test_chat_agrees_with_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(queries.ORACLE["op3_chat_format"]).fetchall()
    assert sorted(map(tuple, queries.op3_chat_format(spark, data).collect())) == sorted(want)


def test_chat_long_and_odd_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t} <|im_end|> \\n \\") for t in range(300)] + [(None, 0, None, None), (None, 0, "assistant", "x"), (2, 1, "a\nb", ""), (2, 1, "a\nb", "")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(frame, context=8)).collect()}
    assert {k: (r["n_turns"], r["rewritten_turns"]) for k, r in got.items()} == {1: (300, 0), None: (2, 0), 2: (2, 0)}
    own = [(r[2], r[3]) for r in rows[:300]]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(b for a, b in own if a == "assistant").encode()).hexdigest()
    assert got[1]["formatted_chars"] == len(chat.chat_template(own))
    assert chat.digests(chat.formatted(frame.where("false"))).count() == 0


def test_chat_finds_rewritten_history(spark):
    template = lambda turns: "".join(f"[{text}]" if i == len(turns) - 1 else "" for i, (_, text) in enumerate(turns))
    frame = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(4)], "conv_id long, turn long, role string, text string")
    assert [r["rewritten"] for r in chat.formatted(frame, template).orderBy("seq").collect()] == [False, True, True, True]


def test_chat_sees_rewrites_beyond_the_window(spark):
    rows = [(1, t, "user" if t % 2 else "system", f"t{t}") for t in range(130)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def dropping(turns):
        return "".join(f"[{r}:{t}]" for r, t in turns[-100:])

    def moving(turns):
        return "".join(f"[{r}:{t}{turns[0][1] if i == len(turns) - 1 else ''}]" for i, (r, t) in enumerate(turns))

    for template in (dropping, moving):
        got = chat.formatted(frame, template).orderBy("seq").collect()
        outputs = [template([(r, t) for _, _, r, t in rows[:k]]) for k in range(131)]
        assert [r["rewritten"] for r in got] == [not b.startswith(a) for a, b in zip(outputs, outputs[1:], strict=False)]
        assert all(r["piece"] == (b if r["rewritten"] else b[len(a) :]) for r, a, b in zip(got, outputs, outputs[1:], strict=False))


def test_chat_finds_templates_wrongly_declared_local(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    @chat.local
    def numbered(turns):
        return "".join(f"[{len(turns) > 12 and i}:{t}]" if i == 0 else f"[{min(i, 12)}:{t}]" for i, (_, t) in enumerate(turns))

    got = chat.formatted(frame, numbered, context=8).orderBy("seq").collect()
    assert next(r["seq"] for r in got if r["rewritten"]) == 12  # as with whole prefixes
    assert got[12]["rewritten"] and "".join(r["piece"] for r in got[12:]) == numbered([("user", t) for _, _, _, t in rows])


def test_chat_checks_the_last_window_too(spark):
    @chat.local
    def turning(turns):  # local up to turn 70, then every turn looks different
        return "".join(f"[{t}{'!' if len(turns) > 70 else ''}]" for _, t in turns)

    @chat.local
    def steady(turns):
        return "".join(f"[{t}]" for _, t in turns)

    rows = [(1, t, "user", f"t{t}") for t in range(100)] + [(2, t, "user", f"u{t}") for t in range(65)] + [(3, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (turning, steady):
        got = {}
        for r in chat.formatted(frame, template).collect():
            got.setdefault(r["conv_id"], []).append((r["seq"], r["piece"], r["rewritten"], r["role"]))
        for conv in (1, 2, 3):
            own = [(r, t) for c, _, r, t in rows if c == conv]
            found = sorted(got[conv])
            assert [f[0] for f in found] == list(range(len(own)))
            outputs = [template(own[:k]) for k in range(len(own) + 1)]
            # as whole prefixes have it, whatever the window
            assert [f[2] for f in found] == [not b.startswith(a) for a, b in zip(outputs, outputs[1:], strict=False)]
            since = max((k for k, f in enumerate(found) if f[2]), default=0)
            assert "".join(f[1] for f in found[since:]) == outputs[-1]
    assert any(f[2] for f in sorted(got[1])) is False


def base_scores(rows):
    tokens = {i: [*WORDS.findall(t.encode().lower()), None] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    return n, {i: (len(ws), sum(train[w] > 0 for w in ws), sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def exact_pair_scores(texts_by_id, prior):
    """log10 probabilities with exact counts of words and pairs, in plain Python."""
    words, both, rows = Counter(), Counter(), {}
    for i, t in texts_by_id:
        rows[i] = ["<", *re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ">"]
        if zlib.crc32(str(i).encode()) % 10:
            words.update(rows[i])
            both.update(zip(rows[i], rows[i][1:], strict=False))
    n, v = sum(words.values()) - words["<"], len(words) - ("<" in words)
    p = lambda a, b: (both[a, b] + prior * (words[b] + 0.1) / (n + 0.1 * (v + 1))) / (words[a] + prior)
    return {i: sum(math.log10(p(a, b)) for a, b in zip(r, r[1:], strict=False)) for i, r in rows.items()}


@pytest.mark.parametrize("bits", [1 << 30, 0])
def test_lm_base_scores(spark, data, bits):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n, want = base_scores(texts(spark, data).items())
    got = lm.score(docs, max_bits=bits).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["train_tokens"], r["n_tokens"], r["n_known"]) == (n, *want[r["doc_id"]][:2])
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_lm_score_is_near_that_of_exact_counts(spark, data):
    d = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.score(docs, prior=65.0).collect()}
    want = exact_pair_scores(texts(spark, d).items(), 65.0)
    off = [abs(got[i]["score"] - x) / (got[i]["n_tokens"] + 10) for i, x in want.items()]
    assert np.mean(off) < 0.02 and max(off) < 0.15  # log10 a token: levels, and pairs that the filter has by mistake


def test_lm_prior_is_learned(spark, data):
    d = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = lambda **k: [sum(r[c] for r in lm.score(docs, **k).collect() if r["held_out"]) for c in ("base_score", "score")]
    base, own = held()
    best = max(held(prior=p)[1] for p in (1.0, 20.0, 200.0, 4000.0))
    assert own - base > 0.95 * (best - base) > 0.15 * abs(base)


def test_lm_mass_of_the_next_word():
    """Over all words and one unknown, probabilities sum to 1 but for false answers of the filter."""
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    p = 1 / np.arange(1.0, len(words) + 1)
    flat = rng.choice(words, 200_000, p=p / p.sum())
    keys, n = np.unique(flat, return_counts=True)
    grams, gram_n = np.unique(lm.gram_hashes(flat, 2) ^ lm.PAIR, return_counts=True)
    lev, glev = lm.level(n), lm.level(gram_n)
    f = lm.Filter(*(lambda w: (w, np.array([0, len(w)])))(lm.fill(np.concatenate([keys, grams]), np.concatenate([lev, glev]))))
    sums = [np.bincount(x, c, lm.LEVELS) / np.maximum(np.bincount(x, minlength=lm.LEVELS), 1) for x, c in ((lev, n), (glev, gram_n))]
    prior = lm.learned_prior(int(n.sum()), np.bincount(lev, minlength=lm.LEVELS), np.bincount(lev, n, lm.LEVELS), int((gram_n == 1).sum()))
    m = lm.Model(int(n.sum()), len(keys), prior, *sums)
    found = f.levels(keys)
    mass = []
    for k in range(0, 300, 3):
        pair = lm.gram_hashes(np.stack([np.full(len(keys), keys[k]), keys], 1).ravel(), 2)[::2] ^ lm.PAIR
        known = m.pair_log10(f.levels(pair), found) - m.context_log10(found[k])
        mass.append((10**known).sum() + prior * m.unigram(np.zeros(1))[0] / 10 ** m.context_log10(found[k]))
    weight = n[:300:3] / n[:300:3].sum()
    assert abs(np.dot(mass, weight) - 1) < 0.06
    assert abs(m.unigram(m.word_value[found]).sum() + m.unigram(0.0) - 1) < 0.01


def test_lm_odd_tables(spark, odd, none):
    got = lm.score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len((t or "").encode().split()) + 1) for i, t, *_ in ODD)
    assert lm.score(none).count() == 0


@pytest.mark.parametrize("how", [{"max_bits": 0}, {"broadcast_words": 0}])
def test_lm_dealt_scores_are_those_of_the_filter_sent(spark, monkeypatch, how):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.5, 60).clip(1, 60))) for i in range(80)] + [(None, "w1 w2"), (None, "w1 w2"), (81, None), (82, "w1 w1 w2"), (82, "w1 w1 w2"), (83, "new " * 40), (84, "q" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda **k: sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, **k).collect()))
    for least in (4, 4096):  # few slices: hardly a word or pair is sent
        monkeypatch.setattr(lm, "LEAST_SLICES", least)
        assert told(**how) == told()


def test_lm_rounds_take_little_disk(spark, data, monkeypatch):
    """Beyond the bounds a token is not a row: what is written on the way is under twice the input, and scores are the same."""
    path = data.replace("0.001", "0.01") + "/documents.parquet"
    docs = spark.read.parquet(path)
    told = lambda **k: {r["doc_id"]: tuple(r) for r in lm.score(docs, **k).collect()}
    monkeypatch.setattr(lm, "LEAST_SLICES", 16)
    monkeypatch.setattr(lm, "ROUND", 100_000, raising=False)
    want, written, plain = told(), [], lm.stage

    def stage(df, name, **options):
        out = plain(df, name, **options)
        written.extend(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm, "stage", stage)
    got = told(max_bits=0)
    assert sum(written) < 2 * os.path.getsize(path)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_lm_rounds_of_odd_tables(spark, odd, none):
    told = lambda df, bits: Counter((*r[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(df, max_bits=bits).collect())
    assert told(odd, 0) == told(odd, 1 << 30)
    assert not told(none, -1)


def test_bloom_counts():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    counts = np.random.default_rng(2).zipf(1.6, len(keys)).clip(1, 10**6)
    own = [lm.slice_of(keys, 8) == s for s in range(8)]
    parts = [lm.fill(keys[o], lm.level(counts[o])) for o in own]
    f = lm.Filter(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    found = f.levels(keys)
    assert (found >= lm.level(counts)).all() and (found == lm.level(counts)).mean() > 0.98
    absent = np.random.default_rng(3).integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.levels(absent) == 0).mean() > 0.985


def test_long_words_have_hashes_of_their_own():
    word = "a"
    while len(word) < 1 << 14:
        word += word.translate(str.maketrans("ab", "ba"))
    cuts = [word[: 1 << k] for k in range(3, 15)]
    texts_ = [*cuts, *(w.translate(str.maketrans("ab", "ba")) for w in cuts), word[:64].upper()]
    hashes, _ = hashed_words(pa.array(texts_))
    assert len(set(hashes.tolist())) == len(texts_) - 1 and hashes[-1] == hashes[3]


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.A.org:80/x/?utm_source=q#f", 10, False, h(etag="1", last_modified="m", content_length="5", date="10")),
        (2, "https://a.org/x", 20, True, h(etag="W/1", date="20", content_length="0")),
        (3, "https://a.org/x", 15, False, None),
        (4, "https://a.org/x", 16, True, h(etag="1")),
        (5, "https://a.org/x", 5, True, h(etag="1")),
        (6, None, 5, True, h(etag="1")),
        (7, "https://a.org/y", 1, False, h(last_modified="m")),
        (8, "https://a.org/y", None, True, h(last_modified="m")),
        (9, "https://a.org/y", 9000, True, h(last_modified="n")),
        (10, "https://a.org/y", 9001, True, h(last_modified="m", cache_control="c")),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, url string, ts long, revisit boolean, headers map<string,string>, bucket int")
    for buckets in (None, 1, 7):
        got = {r["record_id"]: (r["status"], r["target_id"]) for r in warc.resolve_revisits(frame, buckets).collect()}
        assert got == {2: ("unverified", 3), 4: ("unverified", 3), 5: ("no_response", None), 6: ("no_response", None), 8: ("no_response", None), 9: ("mismatch", 7), 10: ("resolved", 7)}
    assert warc.resolve_revisits(frame.where("record_id <> 3")).where("record_id = 2").first()["headers"] == h(etag="W/1", last_modified="m", content_length="5", date="20")
    assert warc.resolve_revisits(frame.where("false")).count() == 0


def test_toxicity_finds_learned_words(spark, data, odd, none):
    d = data.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in queries.op9_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    model = toxicity.Model({"idiot": 5.0}, ("idiot proof",), 1.0, -2.0)
    rows = [(1, "you 1d!0t"), (2, "you іdіоt"), (3, "an idiot proof lid"), (4, "plain")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}
    none_labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(odd, none_labels)
    assert toxicity.scores(odd, empty).count() == len(ODD)
    assert toxicity.scores(none, empty).count() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_bpe_gives_the_library_s_ids():
    rng, t = np.random.default_rng(5), tokenizer()
    marks = ["a", "B", "'s", "9", " ", "  ", "\n", "\n\n", "\t", "\r", "\u3000", "\x1c", "\x85", "\u00a0", "é", "ß", "漢", "\u200b", "😀", "<|endoftext|>", "<|", "|>", "_", "!?", "\u0301"]
    odd = ["", " ", "  ", None, "a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "x" * 30_000, " " * 5000 + "y", "\n" * 3000, "word " * 2000, "ab" * 9000 + " <|endoftext|>"]
    texts = odd + ["".join(rng.choice(marks, rng.integers(1, 30))) for _ in range(3000)]
    flat, n = packing.ByteBpe(packing.default_vocabulary()).ids(pa.array(texts))
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends, strict=True):
        assert flat[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def check_packing(pieces, wanted, window):
    t, docs, windows = tokenizer(), {}, {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for i, copies in wanted.items():
        ids = [*t.encode(copies[0], add_special_tokens=False).ids, 0]
        own = sorted(docs.pop(i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) * len(copies)
        for r in own:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == packing.crc_of(ids[r["start"] : r["start"] + r["length"]])
    assert not docs
    short = 0
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert (n := sum(r["length"] for r in own)) <= window
        short += n < window
    assert short <= 1


def test_packing(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.piece_crc(packing.pack(docs, window=256, part_windows=16, quantum=64)).collect()
    check_packing(rows, {i: [t] for i, t in texts(spark, data).items()}, 256)
    wanted = {}
    for i, t, *_ in ODD:
        wanted.setdefault(i, []).append(t or "")
    check_packing(packing.piece_crc(packing.pack(odd, window=64, part_windows=2, quantum=16)).collect(), wanted, 64)
    assert packing.pack(none).count() == 0
    special = [(i, t, None) for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "two  spaces \n\n and a" + "b" * 5000, " lead", "trail "])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in special], "doc_id long, text string, source string, queue string, n long")
    check_packing(packing.piece_crc(packing.pack(frame, window=64, part_windows=2, quantum=16)).collect(), {i: [t] for i, t, _ in special}, 64)


def test_packing_many_small_sources(spark):
    rows = [(i, f"word {i} " * (1 + i % 4), f"host{i}") for i in range(400)] + [(1000 + i, "big source text " * 20, "big") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    check_packing(packing.piece_crc(packing.pack(docs, window=64, part_windows=4, quantum=16)).collect(), {i: [t] for i, t, _ in rows}, 64)


def test_packing_serves_many_queues(spark):
    import time

    rows = [(i, " a" * 120, f"s{i % 900:03d}") for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    began = time.time()
    pieces = packing.piece_crc(packing.pack(docs, quantum=16)).collect()
    assert time.time() - began < 60
    check_packing(pieces, {i: [t] for i, t, _ in rows}, 1024)


def test_packing_mixture(spark):
    rows = [(i, " a" * (40 + i % 50), "big" if i % 3 else "mid") for i in range(600)] + [(1000, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    share = {s: sum(len(t) // 2 + 1 for _, t, x in rows if x == s) for s in ("big", "mid")}
    want = share["big"] / sum(share.values())
    windows = {}
    for r in packing.pack(docs, window=512, part_windows=8, quantum=32).collect():
        w = windows.setdefault(r["sequence_id"], Counter())
        w[source[r["doc_id"]]] += r["length"]
    full = [w["big"] / 512 for w in windows.values() if sum(w.values()) == 512]
    assert len(full) > 30 and all(abs(x - want) < 0.13 for x in full)
    assert abs(np.mean(full) - want) < 0.01


def plain_fit(rows):
    """Terms and their weights, and exceptions, by counting over all rows: (text, toxic)."""
    docs = [(toxicity.fold(t or ""), y) for t, y in rows]
    starts = lambda w: ({w[:k] for k in range(4, min(len(w), 12) + 1)} | ({w} if len(w) > 12 or len(w) in (2, 3) else set()))
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    seen = {}
    for words, y in docs:
        for t in {t for w in words for t in starts(w)}:
            seen.setdefault(t, [0, 0])[y] += 1
    odds = lambda c: math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1))
    far = {t: odds(c) for t, c in seen.items() if c[1] >= max(2, n[1] // 200) and odds(c) > 3}
    weights = {t: w for t, w in far.items() if not any(far.get(t[:k], -99) >= w - 1.5 for k in range(2, len(t)))}
    near = {}
    for words, y in docs:
        own = {" ".join(words[i : i + 2]) for i in range(len(words) - 1) if any(s in weights for w in words[i : i + 2] for s in starts(w))}
        for t in own:
            near.setdefault(t, [0, 0])[y] += 1
    return weights, {t for t, c in near.items() if c[0] >= 3 and odds(c) < -1}


def test_toxicity_lexicon_is_that_of_plain_counts(spark):
    rng = np.random.default_rng(9)
    plain, bad = [f"plain{'abcdefghij'[i]}word" for i in range(10)], ["vilest", "vileness", "bad", "ug", "extraordinarilybadword", "scum"]
    rows = []
    for i in range(700):
        y = int(i % 4 == 0)
        words = [*rng.choice(plain, 8), *(rng.choice(bad, 2) if y else (["scum", "pond"] if i % 140 == 1 else []))]
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    weights, exceptions = plain_fit([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5])
    assert model.weights == pytest.approx(weights) and set(model.exceptions) == exceptions
    assert "extraordinarilybadword" not in weights and "extr" in weights and "bad" in weights and "scum pond" in exceptions


def test_toxicity_reads_letters_of_other_shapes():
    assert toxicity.fold("ɡɑʙɪ ꜰ ӏօհѵ ցьβ ɐ ß") [:3] == ["gabi", "ꜰ", "lohv"]
    assert toxicity.fold("ᴀʙᴄᴅᴇ ɨɖɩøŧ") == ["abcde", "idiot"]


def test_toxicity_folds_accents_and_matches_as_plain_python_does():
    assert toxicity.fold("ìdïot İDIOT ıdıot 1d!0t іdіоt") == ["idiot"] * 5
    rng = np.random.default_rng(8)
    words = ["bad", "badly", "ba", "lid", "proof", "x", "worse"]
    model = toxicity.Model({"bad": 2.0, "badl": 3.5, "wor": 1.0}, ("bad lid", "proof badly", "lid worse"), 1.0, 0.0)
    automaton = model.automaton()
    for _ in range(300):
        text = f" {' '.join(rng.choice(words, rng.integers(0, 12)))} "
        inside = {p for e in model.exceptions for a in range(len(text)) if text.startswith(f" {e} ", a) for p in range(a, a + len(e) + 1)}
        want = 0.0
        for a in range(len(text)):
            own = [t for t in model.weights if text.startswith(f" {t}", a)]
            if own and a not in inside:
                want += model.weights[max(own, key=len)]
        assert toxicity.matched_weight(text, automaton) == pytest.approx(want), text


def test_equal_rows_scatter_over_buckets(spark):
    docs = spark.createDataFrame([(1, "same text")] * 3000 + [(i, f"t{i}") for i in range(2, 50)], "doc_id long, text string")
    shuffled = sharding.external_shuffle(docs, bucket_bytes=4000)
    assert sorted(r["rank"] for r in shuffled.collect()) == list(range(3048))
    got = sharding.assign_shards(docs, 4, bucket_bytes=4000).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert sorted(r["n"] for r in got) == [762] * 4 and all(r["top"] == r["n"] - 1 for r in got)


def test_revisits_of_repeated_records_and_clashing_names(spark):
    rows = [(1, "http://a.org/x", 10, False, {"etag": "1"}), (2, "http://a.org/x", 20, True, {"etag": "1"}), (3, "http://a.org/x", 20, True, None)]
    schema = "record_id long, url string, ts long, revisit boolean, headers map<string,string>, own int, u string, b int, end int, carry int, target int, status string, canonical_url string"
    frame = spark.createDataFrame([(*r, 1, "u", 2, 3, 4, 5, "s", "c") for r in rows for _ in range(2)], schema)
    for buckets in (None, 5):
        got = Counter((r["record_id"], r["canonical_url"], r["status"], r["target_id"]) for r in warc.resolve_revisits(frame, buckets).collect())
        assert got == {(2, "a.org/x", "resolved", 1): 2, (3, "a.org/x", "unverified", 1): 2}


def test_revisits_of_one_url_with_a_stray_date(spark):
    # one record far away in time must not put the others into one bucket
    rows = [(i, "http://a.org/x", i, i % 10 != 0, {"etag": str(i // 10)}) for i in range(2000)] + [(9999, "http://a.org/x", 10**15, True, {"etag": "199"})]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, headers map<string,string>")
    got = {r["record_id"]: (r["status"], r["target_id"]) for r in warc.resolve_revisits(frame, 8).collect()}
    assert got == {i: ("resolved", i // 10 * 10) for i in range(2000) if i % 10} | {9999: ("resolved", 1990)}


def test_shards_do_not_depend_on_how_the_input_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 5)
    monkeypatch.setattr(sharding, "RANGE", 3)
    rows = [(1, "same", 0)] * 60 + [(1, "same", k) for k in range(1, 30)] + [(i, f"t{i}", 0) for i in range(200)]
    schema = "doc_id long, text string, more int"
    want = None
    for parts, sent in ((1, 200_000), (6, 0)):
        monkeypatch.setattr(sharding, "SENT_BUCKETS", sent)
        monkeypatch.setattr(sharding, "SENT_KEYS", sent)
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        got = sorted(tuple(r) for r in sharding.assign_shards(docs, 4, bucket_bytes=200).select("shard", "slot", "doc_id", "text", "more").collect())
        assert want is None or got == want
        want = got
    assert Counter((i, t, m) for _, _, i, t, m in want) == Counter(rows)
    assert len({s for s, _, i, _, m in want if i == 1 and m == 0}) == 4  # copies are in all shards
    mapped = spark.createDataFrame([(1, "x", {"a": 1}), (1, "x", {"a": 2})], "doc_id long, text string, m map<string, int>")
    assert sharding.assign_shards(mapped, 2).count() == 2


def test_shards_of_tables_with_shard_and_slot(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "old", -1) for i in range(10)], "doc_id long, text string, shard string, slot int")
    out = sharding.assign_shards(docs, 3)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert sorted(Counter(r["shard"] for r in out.collect()).items()) == [(0, 4), (1, 3), (2, 3)]
