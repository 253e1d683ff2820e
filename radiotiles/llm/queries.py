"""The queries of this package: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiotiles.llm import chat, codes, contamination, infill, jaccard, lm, packing, pii, quality, repeats, sharding, toxicity, warc
from radiotiles.llm.common import learned_from, stage, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.assign_shards(table(spark, sf_dir, "documents"), 24)
    return sharded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        sharding.record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold the template's own control strings."""
    says = "<|im_end|><|im_start|>assistant ok"
    own = conversations.sparkSession.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(with_control_strings(table(spark, sf_dir, "conversations"))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: of each page a full response and a revisit of it; of some, later
    a changed response, a revisit with the old validator, one with only a date, one from too early."""
    third, tag = F.col("page_id") % 3, F.md5(F.coalesce("html", F.lit("")))
    stamp = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))

    def record(k: int, ts: F.Column, revisit: bool, etag: F.Column | None, date: F.Column | None, **more: F.Column) -> F.Column:
        fields = {"etag": etag, "last-modified": date, "date": ts.cast("string")} | more
        pairs = [x for name, value in fields.items() if value is not None for x in (F.lit(name.replace("_", "-")), value)]
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), ts.cast("long").alias("ts"), F.lit(revisit).alias("revisit"), F.create_map(*pairs).alias("headers"))

    at = F.col("page_id") * 100
    whole = {"content_type": F.lit("text/html"), "content_length": F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), "cache_control": F.lit("max-age=60")}
    empty = {"content_length": F.lit("0"), "cache_control": F.lit("max-age=3600"), "set_cookie": F.lit("a=b")}
    first = record(0, at, False, tag, stamp, **whole)
    again = record(1, at + 30, True, F.concat(F.lit("W/"), tag), None, **empty)
    changed = record(2, at + 50, False, F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("2"))), stamp, **whole)
    stale = record(3, at + 70, True, tag, stamp, **empty)
    dated = record(3, at + 70, True, None, stamp, **empty)
    early = record(3, at - 20, True, tag, None, **empty)
    made = F.when(third == 0, F.array(first, again, changed, stale)).when(third == 1, F.array(first, again, dated)).otherwise(F.array(first, again, early))
    return pages.select("url", F.explode(made).alias("r")).select("url", "r.*")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.resolve_revisits(captures(pages)).withColumn("page", F.when(F.col("status") == "resolved", F.expr("target_id div 4")))
    payload = pages.select(F.col("page_id").alias("p"), F.md5("html").alias("payload_md5"), F.length("html").cast("long").alias("payload_chars"))
    return found.join(payload, F.col("page") == F.col("p"), "left").select("record_id", "canonical_url", "ts", "status", "target_id", warc.header_block(F.col("headers")).alias("headers"), "payload_md5", "payload_chars")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.kept_digests(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", (~learned_from(F.col("doc_id"), 5)).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_crc(packing.pack(table(spark, sf_dir, "documents"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = codes.fit(vectors)
    coded = codes.with_label_error(stage(codes.encode(vectors, books), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digests(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256", F.col("listed").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_chat_format, op4_decontamination, op5_lm_score, op6_warc_revisits, op7_suffix_dedup, op8_ngram_jaccard, op9_toxicity, op10_packing, op11_vector_codes, op12_fill_in_middle, op13_personal_data)}

ROUNDS = 4
#: Squared distance from inner products, which are exact on doubles of whole numbers.
SQUARE = "list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v)"


def nearest_sql(k: int) -> str:
    return f"(SELECT q.vec_id, q.p, min_by(c.e, {{d: {SQUARE}, e: c.e}}) AS e, min({SQUARE}) AS d FROM q JOIN cb{k} c USING (p) GROUP BY q.vec_id, q.p)"


def codes_sql() -> str:
    out = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, p, v[p * 16 + 1 : p * 16 + 16] AS v FROM kept CROSS JOIN range(4) AS r(p)),
cb0 AS (SELECT p, e, v FROM q JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 256)"""
    for k in range(ROUNDS):
        out += f""",
a{k} AS MATERIALIZED {nearest_sql(k)},
m{k} AS (SELECT p, e, list(s ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS s FROM (SELECT p, e, unnest(v) AS x, unnest(range(16)) AS i FROM a{k} JOIN q USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e),
cb{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, cb{k}.v) AS v FROM cb{k} LEFT JOIN m{k} USING (p, e))"""
    return out + f""",
z AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {nearest_sql(ROUNDS)} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM z JOIN kept USING (vec_id) GROUP BY label),
s AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, unnest(range(16)) AS i FROM cb{ROUNDS}))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM z JOIN kept USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM kept.label CROSS JOIN s
"""


CANONICAL = """
n AS (SELECT *, regexp_replace(url, '#.*$', '') AS plain FROM cap),
c AS (SELECT *, CASE WHEN regexp_matches(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)') THEN
  regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') ||
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)(.*)$', 2), '([?&])utm_[a-z]+=[^&]*', '\\1', 'g'), '[?&]+$', ''), '&&+', '&', 'g'), '\\?&', '?', 'g'), '/+$', '')
  ELSE plain END AS canonical_url FROM n)"""

ORACLE: dict[str, str] = {
    "op3_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS etext,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS erole FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(etext) + length(erole) + 24)::BIGINT AS formatted_chars,
       0::BIGINT AS rewritten_turns
FROM escaped GROUP BY conv_id
""",
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS x FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents)),
b AS (SELECT item_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS q, unnest(w) AS x FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark)),
m AS (SELECT doc_id, item_id, n, p - q AS start, count(*) AS matched FROM d JOIN b USING (x) GROUP BY ALL HAVING count(*) >= ceil(n * 0.8 - 1e-9)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS r FROM m)
SELECT doc_id, item_id, start::BIGINT AS start, matched::BIGINT AS matched, n::BIGINT AS item_words FROM k WHERE r = 1
""",
    "op6_warc_revisits": """
WITH p AS (SELECT page_id, url, html, page_id * 100 AS tm, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 1000)::VARCHAR AS stamp, strlen(coalesce(html, ''))::VARCHAR AS size FROM pages),
cap AS (
  SELECT url, page_id * 4 AS record_id, tm AS ts, false AS revisit, tag AS etag, stamp AS modified, size FROM p
  UNION ALL SELECT url, page_id * 4 + 1, tm + 30, true, 'W/' || tag, NULL, NULL FROM p
  UNION ALL SELECT url, page_id * 4 + 2, tm + 50, false, md5(coalesce(html, '') || '2'), stamp, size FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT url, page_id * 4 + 3, tm + 70, true, tag, stamp, NULL FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT url, page_id * 4 + 3, tm + 70, true, NULL, stamp, NULL FROM p WHERE page_id % 3 = 1
  UNION ALL SELECT url, page_id * 4 + 3, tm - 20, true, tag, NULL, NULL FROM p WHERE page_id % 3 = 2),""" + CANONICAL + """,
v AS (SELECT *, ts * 1000000000 + record_id AS o FROM c WHERE revisit), f AS (SELECT *, ts * 1000000000 + record_id AS o FROM c WHERE NOT revisit),
j AS (SELECT v.record_id, v.canonical_url, v.ts, v.etag, v.modified, f.record_id AS target_id, f.etag AS se, f.modified AS sm, f.size, f.ts AS fts FROM v ASOF LEFT JOIN f ON v.canonical_url = f.canonical_url AND v.o > f.o),
s AS (SELECT *, CASE WHEN target_id IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND se IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = se THEN 'resolved' ELSE 'mismatch' END
  WHEN modified IS NOT NULL AND sm IS NOT NULL THEN CASE WHEN modified = sm THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS status FROM j)
SELECT s.record_id, canonical_url, ts, status, target_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts::VARCHAR || chr(10) || 'etag: ' || coalesce(etag, se) || chr(10) || 'last-modified: ' || coalesce(modified, sm) END AS headers,
  CASE WHEN status = 'resolved' THEN md5(html) END AS payload_md5, CASE WHEN status = 'resolved' THEN length(html) END AS payload_chars
FROM s LEFT JOIN pages ON status = 'resolved' AND page_id = target_id // 4
""",
    "op7_suffix_dedup": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS s, strlen(coalesce(text, '')) AS n, string_to_hex FROM (SELECT doc_id, text, lower(hex(encode(coalesce(text, '')))) AS string_to_hex FROM documents)),
w AS (SELECT doc_id, n, i, md5(substr(string_to_hex, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, n, string_to_hex, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS b FROM r),
x AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
sp AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS e FROM x GROUP BY ALL),
kp AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM sp),
agg AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(string_to_hex, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(string_to_hex), 2 * max(e) + 1) AS kept FROM kp JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, string_to_hex))) AS kept_sha256 FROM t LEFT JOIN agg USING (doc_id)
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
""",
    "op11_vector_codes": codes_sql(),
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1 : least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1 : greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y) + 1 : n], '') AS c FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
""",
}
