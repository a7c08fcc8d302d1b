"""The numbered queries, with check SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapescope.llm import attention, chat, decontam, fim, hardneg, neardup, packing, pii, quality, sharding, tokencount, toxicity, warc
from tapescope.llm.common import ready, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, m, i, item_id FROM g JOIN p USING (m, g)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    found = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_intersect(list_distinct(w), [{_STOPS}])) AS BIGINT) AS stop_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN li USING (doc_id)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND mean_word_chars BETWEEN 2.0 AND 20.0 AND symbol_ratio <= 0.30 AND dup_line_ratio <= 0.50
       AND (stop_words >= 1 OR n_words < 50) AS kept
FROM f
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = sharding.shuffle_into(sharding.sized(table(spark, sf_dir, "documents")), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    pieces = packing.tokenize(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    found = pii.find(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


_B32 = " || ".join(f"substr('{warc.BASE32}', CAST((n[{i + 1}] >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS size, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS newest FROM p),
n AS (SELECT *, [CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS n FROM h)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to
FROM n
"""


@query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, least_bytes=0)
    back = warc.read(spark, path).where("kind = 'record'")
    page = lambda uri: F.regexp_extract(uri, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    is_revisit = F.col("record_type") == "revisit"
    return back.select(page("record_id").alias("page_id"), F.when(is_revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
                       F.substring("digest", 6, 32).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


_OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]')) + {marks} AS n,
             length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
             + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + {frame} AS chars FROM c),
p AS (SELECT *, row_number() OVER w AS pos, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS ends, first_value(role) OVER w AS r1, first_value(n) OVER w AS n1
      FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
o AS (SELECT *, greatest(1, CAST(floor(({budget} - {history} - greatest({system}, CASE WHEN r1 = 'system' THEN n1 ELSE 0 END)) / 2) AS BIGINT)) AS half FROM p),
l AS (SELECT *, pos = 1 AND role = 'system' AS lead, ends - n AS starts, n > half AS long FROM o),
f AS (SELECT *, NOT lead AND (pos = 1 OR lag(lead) OVER w OR long OR lag(long) OVER w OR starts // half != lag(starts) OVER w // half) AS fresh
      FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM f),
e AS (SELECT *, max(span) OVER (PARTITION BY conv_id) AS spans, max(ends) OVER (PARTITION BY conv_id, span) AS span_ends FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * CASE WHEN lead THEN greatest(1, spans) WHEN span < spans AND span_ends - starts <= {history} THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
OP7_SQL = _OP7_SQL.format(marks=chat.MARKS, system=chat.SYSTEM, history=chat.HISTORY, budget=chat.BUDGET,
                          frame=len(chat.BEGIN) + 1 + len(chat.END))


@query("op7_chat_windows", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    given = table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    back = chat.parsed(chat.windows(given.unionByName(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_conv = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", whole.alias("t")).alias("_t"),
                          F.struct("window", F.array_join("targets", "").alias("t")).alias("_l")).groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list("_t")).alias("_t"), F.sort_array(F.collect_list("_l")).alias("_l"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform(c, lambda w: w["t"]), "")
    return by_conv.select("conv_id", "n_turns", F.sha2(joined("_t"), 256).alias("turns_sha256"), F.length(joined("_l")).cast("long").alias("loss_chars"),
                          F.sha2(joined("_l"), 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
        UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT r.a AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a, n.n
"""


@query("op3_near_duplicates", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return neardup.grouped(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).scored(docs)
    doc_id = F.col("row.doc_id").cast("long")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(toxicity.fold(doc_id) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

#: What the edits of op5 insert: letters, contractions, white space, digits, other scripts, nothing.
_INSERTS = (" and", "x", "'ll", "  ", "\n", "1", "é", "", " the quick brown", "!?")


@query("op5_edit_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after four edits whose places its id and length fix."""
    ready(spark)
    trees = tokencount.build(table(spark, sf_dir, "documents"))
    h = lambda i, k: F.xxhash64("doc_id", F.lit(i), F.lit(k))
    edits = F.array(*[F.struct(F.pmod(h(i, 0), F.length(F.coalesce("text", F.lit(""))) + 1).cast("int").alias("at"), F.pmod(h(i, 1), F.lit(12)).cast("int").alias("delete"),
                               F.get(F.array(*map(F.lit, _INSERTS)), F.pmod(h(i, 2), F.lit(len(_INSERTS))).cast("int")).alias("insert")) for i in range(4)])
    out = tokencount.edited(trees.withColumn("edits", edits))
    return out.select("doc_id", "n_pretokens", "n_tokens", "n_tokens_after", "n_reencoded", F.length("text").cast("long").alias("chars_after"))


@query("op11_attention")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return attention.score(table(spark, sf_dir, "documents").select("doc_id", "text", attention.held_out(F.col("doc_id")).alias("held_out")))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("is_anchor"))
    return hardneg.mine(rows)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
           FROM documents),
k AS (SELECT *, CAST(len(t) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h4 FROM d),
c AS (SELECT *, CAST(least(h4[1] % (n + 1), h4[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS BIGINT) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 90 THEN 'plain'
                  WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, array_to_string(list_slice(t, 1, a), '') AS prefix, array_to_string(list_slice(t, a + 1, b), '') AS middle, array_to_string(list_slice(t, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
