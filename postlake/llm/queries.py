"""The operators applied to whole tables, as registered queries."""

from __future__ import annotations

import base64

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import conversations, jaccard, language, lattice, negatives, packing, pages, suffixes, toxicity, urls, warc, winnowing, wordpiece
from postlake.llm.shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select(
        F.col("doc").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("page").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn=~_held_out("doc", 5, 0))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, learn=~_held_out("doc", 3, 1))
    return language.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(_held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_words").alias("n_words"), F.col("_cut").alias("n_cut"), F.col("_text").alias("text"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = word_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.with_counts(docs, first, later, mark=b" ").select("doc_id", "n_tokens")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = table(spark, sf_dir, "pages"), warc.archive_folder(spark)
    found = warc.read(warc.write(rows, folder), folder, rows.schema["page_id"].dataType, payload=False)
    # A digest that does not fit what was read is no digest.
    return found.select(F.col("page").alias("page_id"), "payload_bytes", F.when(F.col("valid"), F.col("payload_digest")).alias("payload_digest"),
                        "record_type", "refers_to")


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.col("vec").eqNullSafe(F.col("component")).alias("kept"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hurt = conversations.damaged(rows, F.crc32(name.cast("binary")) % 20)
    found = conversations.summaries(conversations.repair(hurt)).withColumnRenamed("sha256", "repaired_sha256")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = (F.col("label").cast("decimal(20,0)") + 1) % 10
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).cast("long"))
    found = negatives.mine(rows, F.col("vec_id") % 50 == 0)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
                        "positive_score", "negative_score")


SQL_NEGATIVES = """
with rows as (select row_number() over () as id, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                     list_transform(embedding, lambda x: floor(256 * x::double)) as ints
              from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     scored as (select a.id, a.vec_id as anchor_id, r.id as other, r.vec_id, r.label = a.label as same, list_inner_product(a.ints, r.ints)::bigint as score
                from rows a join rows r on a.id <> r.id and len(a.ints) = len(r.ints) where a.vec_id % 50 = 0),
     near as (select *, row_number() over (partition by id order by score desc, vec_id nulls last, other) as place from scored where same),
     hard as (select n.id, n.anchor_id, n.vec_id as positive_id, n.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
                     row_number() over (partition by n.id, n.place order by s.score desc, s.vec_id nulls last, s.other) as rank
              from near n join scored s on n.id = s.id and not s.same and 50 * n.score <= 100 * s.score and 100 * s.score <= 95 * n.score where n.place <= 5)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from hard where rank <= 3
"""

#: The host, the path and the verdict of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL_URLS = """
with split as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as id from pages),
     rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     fits as (select id, r.host || r.path as rule, verdict, row_number() over (partition by id order by length(r.host || r.path) desc, length(r.host) desc) as place
              from split s join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from split left join fits on split.id = fits.id and place = 1
"""

SQL_WARC = """
with rows as (select page_id, coalesce(html, '') as payload from pages),
     keepers as (select payload, max(page_id) as keeper from rows where strlen(payload) >= 1000 group by payload)
select page_id, strlen(r.payload)::bigint as payload_bytes, sha1(r.payload) as payload_digest,
       case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from keeper then keeper end as refers_to
from rows r left join keepers k on r.payload = k.payload
"""


def word_pieces(ranks: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a vocabulary that begin a word, which have a space in front, and those that go on in it."""
    with open(ranks, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [p for p in pieces if p.startswith(b" ")], [p for p in pieces if not p.startswith(b" ")]


def _held_out(key: str, parts: int, rest: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest


QUERIES = {f.__name__: f for f in (op1_packing, op2_main_text, op3_toxicity, op4_language, op5_suffixes, op6_winnowing, op7_wordpiece, op8_warc, op9_lattice, op10_jaccard, op11_conversations, op12_negatives, op13_urls)}
SQL: dict[str, str] = {"op8_warc": SQL_WARC, "op12_negatives": SQL_NEGATIVES, "op13_urls": SQL_URLS}
