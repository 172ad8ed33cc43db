"""The registered query of each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloam.llm import chat, concat, decontaminate, fertility, infill, kneser_ney, licenses, near_dedup, packing, prefix_counts, resample, sharding, warc
from webloam.llm.common import fresh_path


#: What both turns of conversation -7 say.
TRICKY = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    read = chat.format_chats(rows).withColumns({
        "_turns": chat.read_turns(F.col("formatted")), "_learned": chat.learned_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"), F.sha2(F.col("_learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: The marks of a block with an empty role have 15 characters, a joint has 7.
OP1_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '>', '')) AS chars,
         length(role) + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '>', '')) AS role_chars FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN before = role THEN 7 ELSE 15 + role_chars END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    written = sharding.write_shards(
        docs, fresh_path(spark, "shards"), 16, ["n_chars", "lang", "source"], "text", size, "doc_id")
    rows = written.select("shard", "_part", "_curve", "_group", "_size", "doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.with_slots(rows.withColumn("size", F.col("_size")), "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    # responses answer by their payloads, revisits by their headers
    responses = warc.read_warc(spark, path).filter(F.col("record_type") == "response").select(
        "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisits = warc.read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(
        "record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"))
    return responses.unionByName(revisits).select(
        warc.page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_id_of(F.col("refers_to")).alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"), fence=fertility.FENCES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.token_prefixes(table(spark, sf_dir, "documents"))
    n = prefix_counts.n_tokens(F.col("prefix_tokens"))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > 2048).alias("over_limit"),
        prefix_counts.longest_prefix(F.col("prefix_tokens"), 2048).alias("chars_in_limit"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op11_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concat.concat_and_cut(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = infill.restored(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return changed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT doc_id, text, length(text) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(text) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(text) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, substr(text, 1, least(x, y)) AS prefix, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle,
         substr(text, greatest(x, y) + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_warc": op3_warc,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_concat_and_cut": op11_concat_and_cut,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: SQL twins, where SQL can express the whole query.
SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op3_warc": OP3_SQL, "op13_fill_in_middle": OP13_SQL}
