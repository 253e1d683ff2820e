"""Vector codes, fill-in-middle and personal data against plain versions, and over odd tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from radiotiles.llm import codes, infill, pii, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_nearest(x, entries):
    """Numbers and squared distances by comparing with every entry."""
    d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label) -> {id: (code, error)} and the codebooks."""
    kept = sorted((i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v))
    x = np.array([v for _, v in kept], np.int64)
    d = x.shape[1] // parts
    books = [x[:entries, p * d : (p + 1) * d].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = x[:, p * d : (p + 1) * d]
            at, _ = plain_nearest(own, books[p])
            for e in set(at.tolist()):
                books[p][e] = own[at == e].sum(0) // (at == e).sum()
    found = [plain_nearest(x[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
    return {kept[r][0]: ("".join(f"{found[p][0][r]:02x}" for p in range(parts)), int(sum(found[p][1][r] for p in range(parts)))) for r in range(len(kept))}, np.stack(books)


@pytest.mark.parametrize(("k", "d", "spread"), [(256, 16, 130), (70, 3, 4), (64, 1, 1), (1, 5, 50), (256, 2, 0)])
def test_sliced_masks_find_the_nearest_entry(k, d, spread):
    rng = np.random.default_rng(k + d)
    entries = np.rint(rng.normal(size=(k, d)) * spread).astype(np.int64)
    x = np.concatenate([np.rint(rng.normal(size=(1500, d)) * spread * 2).astype(np.int64), entries, entries * 40])
    got, want = codes.Slices(entries).nearest(x), plain_nearest(x, entries)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_codes_agree_with_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=12) * 0.2)], i % 3) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 7) for i in range(400)]  # copies of one vector
    rows += [(2000, None, 1), (2001, [0.1] * 11 + [None], 1), (2002, [0.1] * 11 + [float("nan")], None), (2003, [float("inf")] + [0.0] * 11, 0), (2004, [-0.0001] * 12, None), (-5, [0.5] * 12, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    books = codes.fit(df, 3, 40, 4)
    want, plain_books = plain_codes(rows, 3, 40, 4)
    assert (books.values == plain_books).all()
    assert books.sha256() == hashlib.sha256(",".join(str(v) for b in plain_books for e in b for v in e).encode()).hexdigest()
    coded = codes.encode(df, books).cache()
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == want
    sums = {}
    labels = {i: lab for i, _, lab in rows}
    for i, (_, e) in want.items():
        sums[labels[i]] = sums.get(labels[i], 0) + e
    assert {r.vec_id: r.label_error for r in codes.with_label_error(coded).collect()} == {i: sums[labels[i]] for i in want}
    values = {r.vec_id: r.vector for r in codes.decode(coded, books).collect()}
    code = want[5][0]
    assert values[5] == pytest.approx(np.concatenate([plain_books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(3)]) / 1024)


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    books = codes.fit(none)
    assert books.values.shape == (4, 0, 1) and codes.encode(none, books).count() == 0 and codes.with_label_error(codes.encode(none, books)).count() == 0
    schema = VECTORS + ", code int, error string, `a.b` int"
    rows = [(1, [0.5, 0.25], 1, 1, "e", 2), (1, [0.5, 0.25], 1, 1, "e", 2), (None, [], None, 1, "e", 2), (2, [1e30, -1e30, 0.1, 0.2, 0.3], 1, 1, "e", 2), (3, None, 1, 1, "e", 2)]
    odd = spark.createDataFrame(rows, schema)
    books = codes.fit(odd)
    coded = codes.encode(odd, books)
    assert coded.columns == ["vec_id", "label", "a.b", "code", "error"] and books.values.shape == (4, 4, 2)
    got = [(r.vec_id, r.error) for r in coded.collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 0), (None, 0)]
    assert books.values.max() == codes.LARGEST and books.values.min() == -codes.LARGEST


def test_integers_floor_down():
    assert codes.integers(pa.array([[-0.0001, 0.0001], [-1.0, 1.0009765]]), 2).tolist() == [[-1, 0], [-1024, 1024]]


TEXTS = [None, "", " ", "\n\t ", "one", "  two words ", "é", "ñ ü 漢字 𝒳𝒴 z", "a<P>b c", "x<S", "<", "P> <M", "plain ascii only\nwith lines \x0b\x0c\r end", "𝒳" * 50 + " " + "é" * 30, "w é " * 20000]
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text, seed=42, rate=50, spm=80, unit="token"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    out = f"<S>{c}<P>{a}<M>{b}" if h[3] % 100 < spm else f"<P>{a}<S>{c}<M>{b}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(a), len(b), out


@pytest.mark.parametrize(("rate", "spm", "unit"), [(50, 80, "token"), (100, 50, "char"), (100, 0, "token"), (0, 80, "token")])
def test_infill_agrees_with_a_plain_version(spark, rate, spm, unit):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é漢𝒳 \n<PSM>") for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id é here"), (5, "again é"), (5, "again é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.transformed(df, rate=rate, spm_rate=spm, unit=unit)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()]
    want = [(i, *plain_infill(i, t, 42, rate, spm, unit), t or "") for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if rate == 100:
        assert {g[2] for g in got} >= {"psm", "plain"}


def test_infill_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a é b", 1, 2, "x", 3, 4)], "doc_id long, text string, n int, form int, output string, other int, `a.b` int")
    assert infill.transformed(df).columns == ["doc_id", "other", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infill.transformed(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="unit"):
        infill.transformed(df, unit="line")


def test_exception_index_goes_both_ways():
    text = "aé漢b𝒳c"
    buf = np.frombuffer(text.encode(), np.uint8)
    index = infill.Exceptions.of(buf)
    assert len(index.at) == 3  # ASCII characters have no place in it
    cuts = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.to_chars(cuts).tolist() == list(range(len(text) + 1))
    assert (index.to_bytes(np.arange(len(text) + 1)) == cuts).all()


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    doubled = [sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def with_luhn(digits):
    return next(digits + c for c in "0123456789" if plain_luhn(digits + c))


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(5)
    pieces = ["@", ".", "-", "+", " ", "a", "b.c", "x@y.z", "1", "22", "255", "256", "0004", "(", ")", "é", "4111 1111 1111 1111", with_luhn("37828224631000"), "+1 (826) 555-4081", "10.0.0.1", "_", "%", "١"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(4000)] + [(t or "")[:2000] for t in TEXTS]
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s[4]] == plain_base(t), t


def test_base_spans_of_the_documents(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_personal_data(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cards 2353820953013749 4111111111111111 end", [("card", "4111111111111111")]),  # one run of 32 digits
        ("paid 4111 1111 1111 1111 12 times", [("card", "4111 1111 1111 1111")]),
        ("order 2353820953013749 4111111111111111 shipped", []),  # another kind of number
        ("Des +1 (826) 555-4081 190.137.223.204 du", [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]),
        ("my IBAN is DE89 3704 0044 0532 0130 00 AB ok", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("GB82WEST12345698765432", [("iban", "GB82WEST12345698765432")]),
        ("GB83WEST12345698765432", []),  # fails the remainder
        ("write to ann.lee [at] mail [dot] example [dot] com today", [("email", "ann.lee [at] mail [dot] example [dot] com")]),
        ("meet (at) noon.", []),
        ("call 555-123-4567 now", [("phone", "555-123-4567")]),
        ("sum 555-123-4567 now", []),  # nothing says phone
        ("SSN 123-45-6789", [("ssn", "123-45-6789")]),
        ("part 123-45-6789", []),
        ("SSN 666-45-6789", []),
        ("no data here, 42 of 100 at 3.14 and 1.2.3", []),
    ],
)
def test_validators_and_context_add_spans(text, want):
    spans = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _, _ in spans] == want
    masked = pii.masked_text(text, spans)
    assert all(value not in masked for _, value in want) and masked.count("<") == len(want)


def test_patterns_are_linear():
    import time

    for t in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "+1 " * 100_000, "a@" * 150_000, "A1" * 200_000, "GB82 " * 80_000, "(" * 300_000, "4111111111111111 " * 20_000):
        began = time.time()
        pii.find_spans(t + " x@y")
        assert time.time() - began < 10, t[:10]


def test_personal_data_of_odd_tables(spark):
    rows = [(1, None, 1, 2), (1, "", 1, 2), (None, "x@y.zz", 1, 2), (3, "x@y.zz", 1, 2), (3, "x@y.zz", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, `a.b` int")
    got = pii.personal_data(df, mask=True)
    assert got.columns == ["doc_id", "a.b", "spans", "masked"]
    assert sorted((str(r.doc_id), r.masked, len(r.spans)) for r in got.collect()) == [("1", "", 0), ("1", "", 0), ("3", "<email>", 1), ("3", "<email>", 1), ("None", "<email>", 1)]
    assert pii.digests(pii.personal_data(df.where("false"))).count() == 0
    assert pii.digests(pii.personal_data(df)).select(F.sum("n_email")).first()[0] == 3
