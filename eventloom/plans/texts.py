"""Queries on texts: references, facts, literals, quotes, windows, credentials; and sources and sinks."""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import anchors, refs
from eventloom.functions import text as ft
from eventloom.functions.shell import Shell
from eventloom.session import table
from eventloom.shared import shared_dir

LITERALS = ("license", "the", "token", "est", "der")


def _path(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def src02(s, d):
    return table(s, d, "events").select("event_id", F.array_join(F.sort_array(F.json_object_keys("props")), ",").alias("data_keys"), F.length(F.get_json_object("props", "$.k")).cast("long").alias("k_len"))


def src03(s, d):
    """An action's name: given, else its type, else bash where there is a command."""
    has = F.array_contains(F.json_object_keys("props"), "k")
    return table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.action"), F.when(F.col("event_type") != "error", F.col("event_type")), F.when(has, F.lit("bash"))).alias("action"))


def src04(s, d):
    """Wide text apart from the narrow columns, both by id."""
    docs = table(s, d, "documents")
    main, text = _path(s, "main"), _path(s, "text")
    docs.select("doc_id", "lang", F.length("text").cast("long").alias("text_len")).write.parquet(main)
    docs.select("doc_id", "text").write.parquet(text)
    return s.read.parquet(main).join(s.read.parquet(text), "doc_id").select("doc_id", "lang", "text_len", F.sha2("text", 256).alias("sha"))


def src05(s, d):
    """Numbers and times from text; what does not parse is null."""
    v = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    t = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    e = table(s, d, "events").withColumn("v", v).withColumn("t", t)
    return e.select("event_id", F.expr("try_cast(v AS DOUBLE)").alias("value"), F.expr("try_cast(t AS TIMESTAMP_NTZ)").alias("ts"))


def src09(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.substring("text", 1, 100), 256).alias("head"), F.sha2("text", 256).alias("whole"))


def src10(s, d):
    """A CSV dimension with a declared schema, and what is wrong with it."""
    p = _path(s, "dim")
    table(s, d, "nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 9 == 0, 99).otherwise(F.col("n_regionkey"))).write.option("header", True).csv(p)
    n = s.read.schema("n_nationkey INT, n_name STRING, n_regionkey INT").option("header", True).csv(p)
    x = n.join(F.broadcast(table(s, d, "region")), n.n_regionkey == F.col("r_regionkey"), "left")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("r_name").isNull()).alias("orphans"), F.count_if(F.col("n_name").isNull()).alias("unnamed"))


RULES = [("licensed", "licen[sc]e"), ("numbered", "[0-9]{3}"), ("shouting", "[A-Z]{4,}!!"), ("table", "\\\\|")]


def src13(s, d):
    labels = F.filter(F.array(*(F.when(F.col("text").rlike(p.replace("\\\\", "\\")), F.lit(n)) for n, p in RULES)), lambda x: x.isNotNull())
    return table(s, d, "documents").select("doc_id", F.array_join(labels, ",").alias("labels"))


SRC13 = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(92) * 2, chr(92))}') THEN '{n}' END" for n, p in RULES) + "], lambda x: x IS NOT NULL), ',') AS labels FROM documents"


def src14(s, d):
    """Documents of nested findings, opened."""
    e = table(s, d, "events").where("event_type = 'error'")
    doc = e.groupBy("user_id").agg(F.to_json(F.struct("user_id", F.collect_list(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "value")).alias("findings"))).alias("raw"))
    x = doc.select(F.from_json("raw", "user_id BIGINT, findings ARRAY<STRUCT<event_id: BIGINT, at: STRING, value: DOUBLE>>").alias("j")).select("j.user_id", F.explode("j.findings").alias("f"))
    return x.select("user_id", "f.event_id", F.to_date(F.substring("f.at", 1, 10)).alias("date"), "f.value")


def src15(s, d):
    p = _path(s, "sorted")
    table(s, d, "orders").repartition(4, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").write.option("compression", "zstd").parquet(p)
    return s.read.parquet(p).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def src16(s, d):
    p = _path(s, "csv")
    g = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 4).alias("m"), F.count("*").alias("n"))
    g.select("l_returnflag", F.format_string("%.4f", "m").alias("m"), F.format_string("%,d", "n").alias("n")).coalesce(1).write.option("header", True).csv(p)
    return s.read.option("header", True).csv(p)


def src19(s, d):
    """Every numeric column of a table as a series."""
    p = table(s, d, "part")
    cols = [f.name for f in p.schema.fields if f.dataType.typeName() in ("integer", "double", "long") and f.name != "p_partkey"]
    return p.select("p_brand", *(F.col(c).cast("double").alias(c) for c in cols)).unpivot("p_brand", cols, "series", "x").groupBy("p_brand", "series").agg(F.round(F.avg("x"), 4).alias("mean"))


def f01(s, d):
    return refs.with_refs(table(s, d, "pages").select("page_id", F.concat_ws(" ", F.lit("see"), "url", F.lit("and /tmp/x/../a.txt, git@host.org:Own/Name.git."), "url").alias("t")), "t").select("page_id", F.array_join("refs", " ").alias("refs"))


def f08(s, d):
    r = F.concat(F.lit("code:github.com/owner"), F.col("page_id") % 7, F.lit("/name"))
    return table(s, d, "pages").select("page_id", refs.hash_owner(r, "salt", ("owner3",)).alias("ref"))


F08 = "SELECT page_id, 'code:github.com/' || CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{'owner3' if i == 3 else 'u_' + hmac.new(b'salt', f'owner{i}'.encode(), hashlib.sha256).hexdigest()[:12]}'" for i in range(7)) + " END || '/name' AS ref FROM pages"


def f09(s, d):
    r = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("code:github.com/o/n#issue:"), "page_id")).when(F.col("page_id") % 4 == 1, F.lit("doc:abc")).when(F.col("page_id") % 4 == 2, F.col("url")).otherwise("/tmp/a")
    return table(s, d, "pages").select("page_id", refs.ref_type(r).alias("kind"))


def f10(s, d):
    x = anchors.with_anchors(table(s, d, "documents").select("doc_id", "text"), "text")
    return x.select("doc_id", F.explode("anchors").alias("a")).groupBy("a.kind").agg(F.count("*").alias("n"), F.countDistinct("a.value").alias("values"))


def f14(s, d):
    """Which words of a list stand in each text, as words."""
    hit = F.filter(F.array(*(F.when(F.lower("text").rlike(f"(^|[^a-z0-9]){w}($|[^a-z0-9])"), F.lit(w)) for w in LITERALS)), lambda x: x.isNotNull())
    return table(s, d, "documents").select("doc_id", F.array_join(hit, ",").alias("found"))


F14 = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN '{w}' END" for w in LITERALS) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents"


def f15(s, d):
    return table(s, d, "documents").select("doc_id", F.lower("text").rlike("license[d]?[^a-z0-9]{1,3}(?:[a-z]+[^a-z0-9]{1,3}){0,2}version").alias("near"))


def f16(s, d):
    """Hashes of lines, and whether a document begins with its source's first line."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    first = F.first(line).over(W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return table(s, d, "documents").select("doc_id", F.substring(F.sha2(line, 256), 1, 16).alias("h"), F.col("text").startswith(first).alias("same_start"))


def f19(s, d):
    """Nine words around the middle of each turn."""
    w = ft.tokens(F.col("text"))
    mid = F.floor(F.size(w) / 2).cast("int")
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(w, F.greatest(mid - 3, F.lit(1)), 9), " ").alias("window"))


def f21(s, d):
    """Words that are capitalised inside a sentence, by first letter."""
    w = F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]+)"), F.lit(1)))
    x = table(s, d, "documents").select(w.alias("w")).where(~F.lower("w").isin("the", "of", "and"))
    return x.groupBy(F.substring("w", 1, 1).alias("c")).agg(F.count("*").alias("n"))


def f22(s, d):
    q = F.regexp_extract_all("text", F.lit('"([^"\n]{3,80})"'), F.lit(1))
    return table(s, d, "documents").where(F.size(q) > 0).select("doc_id", F.array_join(F.transform(q, lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), "|").alias("quotes"))


def f23(s, d):
    """Suppliers that turns name by an alias that means only one of them."""
    a = table(s, d, "documents").select(F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("alias"), (F.col("doc_id") % 12).alias("who")).where("length(alias) >= 2").distinct()
    one = a.groupBy("alias").agg(F.count("*").alias("n"), F.min("who").alias("who")).where("n = 1").select("alias", "who")
    w = table(s, d, "conversations").select("conv_id", F.explode(ft.tokens(F.col("text"))).alias("alias"))
    return w.join(one, "alias").groupBy("conv_id", "who").agg(F.count("*").alias("n"))


def f24(s, d):
    """Values below a key anywhere in nested JSON, walked as a variant."""
    j = F.concat(F.lit('{"a": {"b": ['), "props", F.lit(', {"k": 1}]}, "k": '), F.col("event_id"), F.lit("}"))
    e = table(s, d, "events").select("event_id", F.parse_json(j).alias("v"))
    top = e.select("event_id", F.variant_get("v", "$.k", "bigint").alias("outer"), F.variant_get("v", "$.a.b[0].k", "bigint").alias("inner"))
    return top.groupBy((F.col("inner") >= 50).alias("large")).agg(F.count("*").alias("n"), F.sum("outer").alias("total"))


def f26(s, d):
    """Touches of shell commands, an actor's one after another."""
    cmd = F.element_at(F.array(*map(F.lit, ["cd /srv/app && ls", "cat a.txt > b.txt; rm c.txt", "git commit -m 'x; y' && git push", "curl -X POST https://h.org/p -d @f", "cp x/y.txt ../z", "python run.py | tee out.log", "cat <<'E' > n.txt\nrm all\nE"])), F.expr("CAST(event_id % 7 + 1 AS INT)"))
    e = table(s, d, "events").select("user_id", "ts", "event_id", cmd.alias("command"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shell, rows = Shell(), []
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            rows += [(r.event_id, *t) for t in shell.run(r.command)]
        return pd.DataFrame(rows, columns=["event_id", "mode", "what", "rule"])

    return e.groupBy("user_id").applyInPandas(run, "event_id long, mode string, what string, rule string").groupBy("rule", "mode").agg(F.count("*").alias("n"))


F26 = """
SELECT rule, mode, count(*) AS n FROM events JOIN (VALUES (0, 'cd', 'read'), (1, 'redirect', 'write'), (1, 'read', 'read'), (1, 'file_op', 'write'), (2, 'git_commit', 'write'), (2, 'git_push', 'write'), (3, 'http', 'write'),
       (4, 'cp', 'read'), (4, 'cp', 'write'), (5, 'script', 'read'), (5, 'tee', 'write'), (6, 'heredoc', 'write')) v(c, rule, mode) ON event_id % 7 = c GROUP BY 1, 2"""


def f30(s, d):
    masked = F.regexp_replace("text", 'token = "[0-9a-f]{20,}"', 'token = "***"')
    return table(s, d, "documents").select("doc_id", F.sha2(masked, 256).alias("masked"), (masked != F.col("text")).alias("had"))


def f31(s, d):
    at = F.instr(F.lower("text"), "license")
    return table(s, d, "documents").where(at > 0).select("doc_id", F.substring("text", F.greatest(at - 20, F.lit(1)), F.lit(60)).alias("excerpt"))


QUERIES = {
    "SRC-02_event_keys": (src02, "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS data_keys, length(json_extract_string(props, '$.k')) AS k_len FROM events"),
    "SRC-03_action_names": (src03, "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type ELSE 'bash' END AS action FROM events"),
    "SRC-04_text_apart": (src04, "SELECT doc_id, lang, length(text) AS text_len, sha256(text) AS sha FROM documents"),
    "SRC-05_tolerant_casts": (src05, "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 = 0 THEN date_trunc('second', ts) WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events"),
    "SRC-07_pushed_scan": (lambda s, d: table(s, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'A'").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A'"),
    "SRC-08_wide_scan": (lambda s, d: table(s, d, "documents").select(F.length("text").cast("long").alias("n")).agg(F.sum("n").alias("chars"), F.max("n").alias("longest")), "SELECT CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents"),
    "SRC-09_hash_scan": (src09, "SELECT doc_id, sha256(substr(text, 1, 100)) AS head, sha256(text) AS whole FROM documents"),
    "SRC-10_csv_dimension": (src10, "SELECT count(*) AS n, count(*) FILTER (n_nationkey % 9 = 0) AS orphans, CAST(0 AS BIGINT) AS unnamed FROM nation"),
    "SRC-13_categories": (src13, SRC13),
    "SRC-14_nested_findings": (src14, "SELECT user_id, event_id, CAST(ts AS DATE) AS date, value FROM events WHERE event_type = 'error'"),
    "SRC-15_parquet_sink": (src15, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "SRC-16_csv_sink": (src16, "SELECT l_returnflag, format('{:.4f}', round(avg(l_discount), 4)) AS m, format('{:,}', count(*)) AS n FROM lineitem GROUP BY 1"),
    "SRC-19_external_series": (src19, "SELECT p_brand, series, round(avg(x), 4) AS mean FROM (SELECT p_brand, 'p_size' AS series, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part) GROUP BY 1, 2"),
    "F-01_references": (f01, r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_\w+|ref)=[^&]*', '', 'g'), '/+($|\?)', '\1') || ' /tmp/a.txt code:host.org/own/name' AS refs FROM pages"),
    "F-08_owner_pseudonyms": (f08, F08),
    "F-09_ref_types": (f09, "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'code_issue' WHEN 1 THEN 'doc' WHEN 2 THEN 'url' ELSE 'path' END AS kind FROM pages"),
    "F-10_facts": (f10, None),
    "F-14_literals": (f14, F14),
    "F-15_adjacency": (f15, "SELECT doc_id, regexp_matches(lower(text), 'license[d]?[^a-z0-9]{1,3}(?:[a-z]+[^a-z0-9]{1,3}){0,2}version') AS near FROM documents"),
    "F-16_line_hashes": (f16, "WITH x AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS l, source FROM documents) SELECT doc_id, sha256(l)[1:16] AS h, starts_with(text, first_value(l) OVER (PARTITION BY source ORDER BY doc_id)) AS same_start FROM x"),
    "F-19_token_window": (f19, "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations) SELECT conv_id, turn, array_to_string(w[greatest(len(w) // 2 - 3, 1):greatest(len(w) // 2 - 3, 1) + 8], ' ') AS window FROM w"),
    "F-21_capitalised": (f21, "WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1)) AS w FROM documents) SELECT w[1] AS c, count(*) AS n FROM w WHERE lower(w) NOT IN ('the', 'of', 'and') GROUP BY 1"),
    "F-22_quotes": (f22, "WITH q AS (SELECT doc_id, regexp_extract_all(text, '\"([^\"\\n]{3,80})\"', 1) AS q FROM documents) SELECT doc_id, array_to_string(list_transform(q, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), '|') AS quotes FROM q WHERE len(q) > 0"),
    "F-23_aliases": (f23, "WITH a AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS alias, doc_id % 12 AS who FROM documents), o AS (SELECT alias, min(who) AS who FROM a WHERE length(alias) >= 2 GROUP BY 1 HAVING count(*) = 1), w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS alias FROM conversations) SELECT conv_id, who, count(*) AS n FROM w JOIN o USING (alias) GROUP BY 1, 2"),
    "F-24_nested_values": (f24, "SELECT CAST(json_extract_string(props, '$.k') AS INT) >= 50 AS large, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1"),
    "F-26_shell_touches": (f26, F26),
    "F-30_masked": (f30, "WITH m AS (SELECT doc_id, text, regexp_replace(text, 'token = \"[0-9a-f]{20,}\"', 'token = \"***\"', 'g') AS t FROM documents) SELECT doc_id, sha256(t) AS masked, t <> text AS had FROM m"),
    "F-31_excerpts": (f31, "SELECT doc_id, substr(text, greatest(instr(lower(text), 'license') - 20, 1), 60) AS excerpt FROM documents WHERE instr(lower(text), 'license') > 0"),
}
