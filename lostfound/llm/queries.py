"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, langid, licenses, minhash, mixing, neighbours, packing, phrases, rules, suffixes, toxicity, tries, warc
from .common import fold, scratch, table, written


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return written(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"), "op2")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), index)
    return written(scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted", "evidence", "terms"), "op3")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    scored = compression.score(docs.select("doc_id", "text"), model)
    return written(scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted"), "op4")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that holds a passage of 50 words or more which occurs elsewhere; others have none."""
    done = suffixes.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")
    return done.filter(F.size("spans") > 0).select("doc_id", "spans", "removed", words(F.col("spans")).alias("repeated_words"), words(F.col("removed")).alias("removed_words"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, slim = scratch(spark, "warc-raw"), scratch(spark, "warc-slim")
    warc.write_archives(warc.responses(table(spark, sf_dir, "pages")), raw)
    warc.dedup_archives(spark, raw, slim)
    return warc.resolved(spark, slim).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return written(found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "lang_spans"), "op10")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.rebuilt(table(spark, sf_dir, "conversations"))
    return tries.prefix_trie(*turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return written(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), "op13")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_warc": op7_warc,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_scan": op13_license_scan,
}

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, lower(sha1(body)) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM d),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY 1, 2, 3), t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE k > 1 AND n >= 10),
h AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY 1, 2),
s AS (SELECT c.* FROM c LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
x AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, ws, k FROM s),
y AS (SELECT x.lang, x.phrase, a, cut, l.n AS l, r.n AS r, 1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS score FROM x JOIN f l ON l.lang = x.lang AND l.k = cut AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.k = x.k - cut AND r.phrase = array_to_string(ws[cut + 1:x.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM y),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM b WHERE o = 1)
SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""

# crc32 a bit at a time: each byte is followed by eight steps
_CRC = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"

OP12_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h, count(*) AS own FROM o GROUP BY 1), m AS (SELECT c.*, least(h, coalesce(b.own, 0)) AS g FROM c LEFT JOIN (SELECT conv_id AS base, own FROM c) b USING (base)),
r AS (SELECT m.conv_id, o.pos AS d, role, text FROM m JOIN o ON o.conv_id = m.base AND o.pos <= h UNION ALL SELECT m.conv_id, g + o.pos - h, role, text FROM m JOIN o ON o.conv_id = m.conv_id AND o.pos > h),
k AS (SELECT conv_id, d, md5(length(role) || ':' || role || text) AS k, length(text) AS n FROM r),
l AS (SELECT m.conv_id, coalesce(list(k.k ORDER BY d) FILTER (k.k IS NOT NULL), []) AS ks, coalesce(list(k.n ORDER BY d) FILTER (k.k IS NOT NULL), []) AS ns FROM m LEFT JOIN k ON k.conv_id = m.conv_id GROUP BY 1),
p AS (SELECT conv_id, unnest(range(0, len(ks) + 1)) AS d, ks, ns FROM l),
v AS MATERIALIZED (SELECT d, ks[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * any_value(ns[d]) ELSE 0 END AS saved, string_agg(CASE WHEN len(ks) = d THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY 1, 2),
u AS (SELECT v.*, w.conv_id AS parent_conv_id, (SELECT count(*) FROM v y WHERE y.d = v.d + 1 AND y.path[1:v.d] = v.path) AS n_children FROM v LEFT JOIN v w ON w.d = v.d - 1 AND w.path = v.path[1:v.d - 1]),
a AS (SELECT path, unnest(range(0, d + 1)) AS d, (n_children = 0)::INT AS leaf, saved FROM u), s AS (SELECT d, path[1:d] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1, 2)
SELECT conv_id, u.d AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM u JOIN s ON s.d = u.d AND s.path = u.path
"""

ORACLE: dict[str, str] = {
    "op11_collocations": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op7_warc": OP7_SQL,
}
