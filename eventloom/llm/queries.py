"""One thin query per operator, with production parameters, over its whole table; and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.chat import format_chats, read_back
from eventloom.llm.decontaminate import find_contamination
from eventloom.llm.html import main_text
from eventloom.llm.licenses import scan_licenses
from eventloom.llm.packing import pack
from eventloom.llm.pii import KINDS, find_pii
from eventloom.llm.quality import score_quality
from eventloom.llm.simhash import near_duplicates
from eventloom.llm.substrings import remove_repeats
from eventloom.llm.toxicity import score_toxicity, train


def tokenizer_files() -> dict[str, str]:
    """Where the tokenizer files are; a parameter of every operator that tokenizes."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_items = F.size("bench_items").cast("long")
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        F.aggregate("bench_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.concat_ws(",", "bench_items"), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
     iw AS (SELECT DISTINCT item_id, least(8, len(w)) AS size, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') AS win
            FROM i, range(1, len(w) + 1) t(k) WHERE len(w) > 0 AND k <= len(w) - least(8, len(w)) + 1),
     s AS (SELECT DISTINCT size FROM iw),
     dw AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS win FROM d, s, range(1, len(w) + 1) t(k) WHERE k <= len(w) - size + 1),
     h AS (SELECT dw.r, dw.k, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
     n AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, size FROM h), range(0, 8) t(j) WHERE j < size GROUP BY r),
     m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("string").alias("message_id"))
    return read_back(format_chats(events))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '', '\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
                  '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[ROLE]', '[\ROLE]'), '[TEXT]', '[\TEXT]'), '[/ROLE]', '[\/ROLE]') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(x) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", (F.col("longest_repeat") > 100).alias("long_repeat"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT r, k, size, count(*) OVER (PARTITION BY r, size, hash(x), x) AS n
             FROM (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS x FROM d, (VALUES (3), (10), (101)) s(size), range(1, len(w) + 1) t(k) WHERE k <= len(w) - size + 1)),
     c AS (SELECT r, count(DISTINCT k + j) FILTER (size = 3) AS n3, count(DISTINCT k + j) FILTER (size = 10) AS n10, count(*) FILTER (size = 101) AS n101
           FROM win, range(0, 10) t(j) WHERE n > 1 AND j < least(size, 10) GROUP BY r),
     l AS (SELECT r, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
     f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                  coalesce(n3, 0) AS n_repeat_words, coalesce(n10, 0) AS covered_words, coalesce(n101, 0) > 0 AS long_repeat
           FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.3 * n_words AND NOT long_repeat AS kept
FROM f"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), **tokenizer_files(), with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def _counting(kind: str):
    return lambda n, s: n + (s["kind"] == kind).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.aggregate(base, F.lit(0).cast("long"), _counting(k)).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("licenses", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_decontaminate": (op1_decontaminate, OP1_SQL),
    "op2_chat": (op2_chat, OP2_SQL),
    "op3_html": (op3_html, None),
    "op4_quality": (op4_quality, OP4_SQL),
    "op5_packing": (op5_packing, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_simhash": (op7_simhash, None),
    "op8_pii": (op8_pii, None),
    "op9_substrings": (op9_substrings, None),
    "op10_licenses": (op10_licenses, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
