"""One query per operator of this package over its whole table, with the columns of its digest, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (compression, conversations, crossparse, decontaminate, doubling, interpolation, merkle, packing, radix,
               simhash, template, topk, warc)
from .blocks import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: as of an empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_warc_index(spark, d):
    pages = table(spark, d, "pages")
    archives = warc.write(pages, folder(spark, "warc"))
    found = warc.read(archives, pages.select("page_id", "url"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE["op1_warc_index"] = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS digest,
         strlen(coalesce(html, '')) AS n
  FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN f ON p.digest = f.digest
"""


@query
def op2_deleted_interpolation(spark, d):
    fold = remainder("doc_id", 7)
    scored = interpolation.score(table(spark, d, "documents"), fold != 2, fold == 3)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query
def op3_cross_parsing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = crossparse.fit(docs.filter(remainder("doc_id", 5) != 0))
    keep = [F.col("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out")]
    return crossparse.predict(docs, model, keep)


@query
def op4_compression_quality(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    model = compression.fit(docs, labels.filter(remainder("doc_id", 4) != 2))
    scored = compression.score(docs, model, [F.col("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op5_packing(spark, d):
    return packing.packed(table(spark, d, "documents"), tokenizer_path(), keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op6_template_text(spark, d):
    return template.extract(table(spark, d, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op7_suffix_repeats(spark, d):
    spans = radix.repeated_spans(table(spark, d, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")),
                          F.lit(0).cast("long"), lambda x, y: x + y)
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"),
                        F.size("starts").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash_components(spark, d):
    found = simhash.near_copies(table(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_decontamination(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE["op9_decontamination"] = """
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (
  SELECT side, id, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words FROM low),
windows AS (
  SELECT DISTINCT id AS item, least(13, len(words)) AS n,
         array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM w WHERE side = 'b' AND len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths WHERE side = 'd' AND len(words) >= n)),
found AS (SELECT p.id, p.i, p.n, item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
hit AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM found) GROUP BY id),
items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id)
SELECT w.id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit ON w.id = hit.id LEFT JOIN items ON w.id = items.id WHERE side = 'd'
"""


@query
def op10_top_k(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), topk.quantized("embedding").alias("vec"))
    return topk.top_k(rows, rows.filter(F.col("id") % 20 == 0), 20)


ORACLE["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


#: SQL of crc32 over ASCII text: ``crc(x)`` needs the columns of ``steps`` joined.
_CRC = """
  steps AS (SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
            FROM range(256) AS r(b))"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, {codes}), "
            "lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295)")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_merkle_manifest(spark, d):
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", capitals, capitals.lower()))
    found = merkle.manifest(table(spark, d, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                            changed={"text": F.coalesce(text, F.col("text"))})

    def text_of(digest: Column) -> Column:
        return F.lower(F.hex(digest))

    return found.select(
        "doc_id", *[text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")],
        F.sha2(text_of(F.col("proof")), 256).alias("proof_sha256"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC},
rows AS (
  SELECT doc_id, lang, CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_LOWER.format("text")} ELSE text END AS other,
         {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text
  FROM documents, steps),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS total
  FROM (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("other")}) AS found FROM rows)),
inner_nodes AS (
  SELECT 0 AS level, lang, pos, total, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 8, ceil(total / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY pos))
  FROM inner_nodes WHERE total > 1 GROUP BY level, lang, pos // 8, total),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
  FROM inner_nodes WHERE total = 1),
upper_nodes AS (
  SELECT 0 AS level, pos, total, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, ceil(total / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper_nodes WHERE total > 1 GROUP BY level, pos // 8, total),
groups AS (
  SELECT level, lang, pos // 8 AS run, list(digest ORDER BY pos) AS nodes FROM inner_nodes WHERE total > 1 GROUP BY ALL),
upper_groups AS (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS nodes FROM upper_nodes WHERE total > 1 GROUP BY ALL),
folded AS (
  SELECT row_number() OVER () AS id, doc_id, lang, 0 AS level, pos, found AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT id, doc_id, f.lang, f.level + 1, f.pos // 8,
         sha256(array_to_string(list_concat(nodes[:f.pos % 8], [f.digest], nodes[f.pos % 8 + 2:]), '')),
         proof || array_to_string(list_concat(nodes[:f.pos % 8], nodes[f.pos % 8 + 2:]), '')
  FROM folded f JOIN groups g ON g.level = f.level AND g.run = f.pos // 8 AND g.lang IS NOT DISTINCT FROM f.lang),
tops AS (SELECT id, max_by(digest, level) AS digest, max_by(proof, level) AS proof FROM folded GROUP BY id),
up AS (
  SELECT f.id, f.doc_id, l.subroot, 0 AS level, l.pos, t.digest, t.proof
  FROM (SELECT id, doc_id, lang FROM folded WHERE level = 0) f JOIN tops t USING (id)
  JOIN subroots l ON l.lang IS NOT DISTINCT FROM f.lang
  UNION ALL
  SELECT id, doc_id, subroot, f.level + 1, f.pos // 8,
         sha256(array_to_string(list_concat(nodes[:f.pos % 8], [f.digest], nodes[f.pos % 8 + 2:]), '')),
         proof || array_to_string(list_concat(nodes[:f.pos % 8], nodes[f.pos % 8 + 2:]), '')
  FROM up f JOIN upper_groups g ON g.level = f.level AND g.run = f.pos // 8),
ends AS (SELECT id, max_by(digest, level) AS folded_root, max_by(proof, level) AS proof, any_value(subroot) AS subroot
         FROM up GROUP BY id),
root AS (SELECT digest AS root FROM upper_nodes WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT row_number() OVER () AS id, doc_id, leaf FROM leaves) JOIN ends USING (id), root
"""


@query
def op12_conversation_repair(spark, d):
    return conversations.repair(conversations.damaged(table(spark, d, "conversations"))).drop("repaired")


@query
def op13_substring_dedup(spark, d):
    found = doubling.repeated_passages(table(spark, d, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")),
                          F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), "longest")


ORACLE["op13_substring_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, j, array_to_string(words[j:j + 19], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS j FROM w)),
f AS (SELECT k, min(row(doc_id, j)) AS low, count(*) AS n FROM win GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, unnest(range(j, j + 20)) AS i FROM win JOIN f USING (k) WHERE row(doc_id, j) <> low) GROUP BY doc_id),
kept AS (
  SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS kept FROM (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) x
  ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM gone) g USING (doc_id, i) GROUP BY doc_id),
lv AS (
  SELECT 20 AS len, doc_id, j, md5(k) AS k FROM win JOIN f USING (k)
  UNION ALL
  SELECT len, doc_id, j, k FROM (
    SELECT 2 * a.len AS len, a.doc_id, a.j, md5(a.k || b.k) AS k, count(*) OVER (PARTITION BY md5(a.k || b.k)) AS n
    FROM lv a JOIN lv b ON a.doc_id = b.doc_id AND b.j = a.j + a.len) WHERE n > 1),
most AS (SELECT doc_id, max(len) AS longest FROM lv GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0)::BIGINT AS longest
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN most USING (doc_id)
"""
