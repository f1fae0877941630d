"""Queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, fingerprint, frames, license, lm, neardup, packing, quality, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"

#: The conversation that contract 4 adds: control strings of other templates as plain text.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames.configure(spark)
    return frames.table(spark, sf_dir, name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("benchmark_items") > 0).alias("contaminated"), "benchmark_items")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.graded(docs, model).select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"), quality.selected(model, 1).alias("selected"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.scores(table(spark, sf_dir, "documents"), held)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id").alias("turn")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return chat.digests(chat.read_chats(chat.format_chats(rows.unionByName(extra))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.is_held_out()))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.array_sort(F.array_distinct(sure["family"])).alias("families"),
        F.size(sure).alias("n_confirmed"),
        F.size("licences").alias("n_predicted"),
        F.transform(sure, lambda x: x["paragraph"]).alias("paragraphs"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op6_warc": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL}


OP4_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), seen as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before from rows
), sized as (
  select *,
    length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) as escaped,
    case when before = role then 6
         else length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + 7 + 8 end as marks
  from seen
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(escaped + marks) as bigint) as formatted_chars
from sized group by conv_id
"""

OP6_SQL = r"""
with digests as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), coded as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((('0x' || substr(h, 1 + 10 * (i // 8)::int, 10))::ubigint >> (35 - 5 * (i % 8))::int) & 31 as int) + 1, 1)), '') as payload_digest,
    min(page_id) over (partition by h) as first_
  from digests
)
select page_id, payload_bytes, payload_digest,
  case when page_id = first_ then 'response' else 'revisit' end as record_type,
  case when page_id <> first_ then first_ end as refers_to
from coded
"""

OP9_SQL = r"""
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from tokens
), sized as (
  select doc_id, cast(len(s) as bigint) as n, s from sets
), shingles as (
  select doc_id, n, unnest(s) as g from sized
), pairs as (
  select a.doc_id as a, b.doc_id as b, a.n as an, b.n as bn, count(*) as both_
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by all
), links as (
  select a, b from pairs where 100 * both_ >= 75 * (an + bn - both_)
), edges as (
  select a, b from links union select b, a from links
), reach(a, b) as (
  select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a
), roots as (
  select a as doc_id, min(b) as root from reach group by a
)
select s.doc_id, s.n as n_shingles, least(s.doc_id, coalesce(r.root, s.doc_id)) as component_id,
  s.doc_id <= coalesce(r.root, s.doc_id) as kept
from sized s left join roots r on s.doc_id = r.doc_id
"""
