"""Queries on what actors write and type: references, paths, secrets, facts, typed text, artifacts, touches; Markdown sources; report columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import anchors, desk, encode, markdown, refs
from eventloom.operators.shift import student_t_logpdf
from eventloom.plans.timeline import BLOCKS_SQL
from eventloom.session import table
from eventloom.shared import cached, shared_dir

Cases = list[tuple[str, str | None]]


def _text(cases: Cases):
    """The text of each event's case; {id} in it is the event's own."""
    texts = F.array(*(F.lit(t) for t, _ in cases))
    return F.replace(F.element_at(texts, (F.col("event_id") % len(cases) + 1).cast("int")), F.lit("{id}"), F.col("event_id").cast("string"))


def _mapped(cases: Cases, f: Callable[[str], str | None]):
    """A query that maps each event's text by f, as a pandas function over batches."""

    def q(s, d):
        run = F.pandas_udf(lambda x: x.map(f), "string")
        return table(s, d, "events").select("event_id", run(_text(cases)).alias("got"))

    return q


def _want(cases: Cases) -> str:
    """What the cases' own words say, as SQL."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {i} THEN {quoted(w)}" for i, (_, w) in enumerate(cases))
    return f"SELECT event_id, replace(CASE event_id % {len(cases)} {whens} END, '{{id}}', CAST(event_id AS VARCHAR)) AS got FROM events"


def _pair(cases: Cases, f: Callable[[str], str | None]):
    return _mapped(cases, f), _want(cases)


CANDIDATES: Cases = [
    ("see https://a.org/{id}, or not", "url https://a.org/{id},"),
    ("(www.a.org/x{id}) and ~/b/{id}.txt", "bare www.a.org/x{id}) | path ~/b/{id}.txt"),
    ("git@gitlab.com:g/s/p{id}.git", "remote git@gitlab.com:g/s/p{id}.git"),
    ("gh repo clone own/n{id} && ls", "named gh repo clone own/n{id}"),
    ("glab -R g/h/i{id} issue list", "option glab -R g/h/i{id}"),
    ("gh api repos/o/n/issues/{id}", "api gh api repos/o/n/issues/{id}"),
    ("this and/or that, 1/2 of {id}", ""),
]


def _candidates(t: str) -> str:
    return " | ".join(f"{m.lastgroup} {m.group()}" for m in refs.CANDIDATE.finditer(t))


HOSTS: Cases = [
    ("https://github.com/Own/Name.git", "code:github.com/own/name"),
    ("https://github.com/o/n/issues/{id}#note", "code:github.com/o/n#issue:{id}"),
    ("https://github.com/o/n/blob/main/src/f{id}.py", "code:github.com/o/n#file:src/f{id}.py"),
    ("https://gitlab.com/g/s/p/-/merge_requests/{id}", "code:gitlab.com/g/s/p#pull:{id}"),
    ("https://gitlab.com/g/s/p{id}", "code:gitlab.com/g/s/p{id}"),
    ("https://raw.githubusercontent.com/o/n/main/d/{id}.txt", "code:github.com/o/n#file:d/{id}.txt"),
    ("https://api.github.com/repos/o/n/pulls/{id}", "code:github.com/o/n#pull:{id}"),
    ("https://docs.google.com/document/d/abcdefghijk{id}/edit", "doc:abcdefghijk{id}"),
    ("https://drive.google.com/drive/u/0/folders/abcdefghijk{id}", "doc:abcdefghijk{id}"),
    ("https://drive.google.com/open?usp=x&id=abcdefghijk{id}", "doc:abcdefghijk{id}"),
    ("glab api projects/g%2Fh/issues/{id}", "code:gitlab.com/g/h#issue:{id}"),
    ("ssh://git@github.com/o/n{id}.git", "code:github.com/o/n{id}"),
    ("https://github.com/only{id}", "https://github.com/only{id}"),
    ("https://$HOST/x{id}", None),
]
PATHS: Cases = [
    ("/home/u/./a//b{id}.txt", "/home/u/a/b{id}.txt"),
    ("$HOME/x/../y{id}", "~/y{id}"),
    ("${HOME}/z{id}/", "~/z{id}"),
    ("/etc/passwd{id}", None),
    ("/api/v1/{id}", None),
    ("../up/{id}", "../up/{id}"),
    ("./here/{id}/..", "./here"),
    ("/tmp/../../data/{id}", "/data/{id}"),
    ("/tmp", None),
]
TRAILING: Cases = [
    ("a{id}).", "a{id}"),
    ("f(x{id})", "f(x{id})"),
    ("[a{id}]],", "[a{id}]"),
    ("'{id}'!?", "'{id}"),
    ("...", ""),
    ("plain{id}", "plain{id}"),
]
SECRETS: Cases = [
    ("token", "secret"), ("X-Api-Key", "secret"), ("access_token", "secret"), ("user_password", "secret"), ("token_id", "plain"), ("page{id}", "plain"), ("max-tokens", "plain"),
    ("id ghp_abcdefghij{id} end", "id *** end"), ("key glpat-abcdefghij{id}", "key ***"), ("eyJabcdefghijk.abcdefghijk{id}", "***"), ("no secret {id}", "no secret {id}"),
]


def _secret(t: str) -> str:
    if " " in t or t.startswith("eyJ"):
        return refs.redact(t)
    return "secret" if refs.is_secret_param(t) else "plain"


VALUES: Cases = [
    ("it cost $1,2{id}.50", None),
    ("worth 3.5 million dollars", "money:$3.5"),
    ("up 12.50 percent", "percent:12.5%"),
    ("on March 3rd, 2024 at 5 pm", "date:2024-03-03 time:17:00"),
    ("on 7 July", "date:-----07-07"),
    ("call +44 20 7946 0958", "phone:+442079460958"),
    ("Jane.Doe@Example.ORG wrote {id}0", "email:jane.doe@example.org number:{id}0"),
    ("about €2k or 1,000", "money:€2000 number:1000"),
    ("Big Bird saw 2024-01-09", "actor:bird date:2024-01-09"),
]
VALUES[0] = ("it cost $12,345.50", "money:$12345.5")
VALUES[1] = ("worth $3.5 million", "money:$3500000")


def _values(t: str) -> str:
    return " ".join(f"{k}:{v}" for _, _, k, v in anchors.anchors(t, {"big bird": "bird", "bird": "bird"}))


CONTEXTS: Cases = [
    ("The total was {id}.", "total"),
    ("It rained. {id} people came.", "people"),
    ("Sales in the north of {id}", "north"),
    ("{id}", None),
    ("A price of the {id} and more", "price"),
]


def _context(t: str) -> str | None:
    found = anchors.anchors(t)
    return anchors.context_key(t, *found[0][:2]) if found else None


TYPED: Cases = [
    ("cd /tmp/{id} && ls", "shell"), ("git status", "shell"), ("https://a.org/{id}", "url"), ("example.com", "url"), ("hunter2!x{id}", "credential"), ("def f(x):\n    return x == {id}", "code"),
    ("from:me subject:{id}", "search"), ("ok", "short_input"), ("north", "short_input"), ("Room {id}", "form_field"), ("This is a sentence of number {id}.", "prose"), ("# only a remark", "form_field"), ("", "other"),
    ("one line of more than four words here", "prose"),
]
ARTIFACTS: Cases = [
    ("doc:abc{id}", "doc:abc{id} doc:abc{id} doc"),
    ("code:github.com/o/n#issue:{id}", "code:github.com/o/n#issue:{id} code:github.com/o/n code"),
    ("~/work/p{id}/a/b.txt", "local:me:~/work/p{id}/a/b.txt local:me:~/work/p{id} local"),
    ("~/.cache/{id}", None),
    ("http://localhost:80{id}/x", "local:me:localhost:80{id}/x local:me:localhost:80{id} local"),
    ("https://www.a.org/p/{id}?q=1", "url:a.org/p/{id} url:a.org/p/{id} url"),
    ("https://google.com/search/{id}", None),
    ("https://a.org", None),
    ("https://mail.google.com/m/{id}", "local:me:mail.google.com/m/{id} local:me:mail.google.com/m/{id} local"),
]
CONTAINERS: Cases = [
    ("~/a{id}/b/c", "~/a{id}"),
    ("~/projects/p{id}/c", "~/projects/p{id}"),
    ("/tmp/x{id}/y", "/tmp/x{id}"),
    ("/home/u/p{id}/y/z", "/home/u/p{id}"),
    ("/srv/root/deep/er/{id}", "/srv/root/deep"),
    ("~/f{id}.txt", "~/f{id}.txt"),
]
PAGES: Cases = [
    ("# Title {id} #\n\nA *b* **c {id}** `d*e*`", "<h1>Title {id}</h1>\n<p>A <em>b</em> <strong>c {id}</strong> <code>d*e*</code></p>"),
    ("- one\n- two\n  more {id}\n\n1. x", "<ul><li>one</li><li>two more {id}</li></ul>\n<ol><li>x</li></ol>"),
    ("```\n<a> & {id}\n```", "<pre><code>&lt;a&gt; &amp; {id}</code></pre>"),
    ("| a | b |\n|---|---|\n| 1 | {id} |", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>{id}</td></tr></tbody></table>"),
    ("[x {id}](https://a.org/{id}) <b>", '<p><a href="https://a.org/{id}">x {id}</a> &lt;b&gt;</p>'),
    ("[x](javascript:{id})", "<p>[x](javascript:{id})</p>"),
]


def _artifact(ref: str) -> str | None:
    got = desk.artifact(ref, "me")
    return " ".join(got) if got else None


def _container(p: str) -> str:
    return desk.container(p, frozenset(("/srv/root/deep", "/srv/root")))


# ---------------------------------------------------------------- Markdown sources

LOG = """# Log

## Roster

| Name | Model | Joined | Left |
| --- | --- | --- | --- |
| Ann | `m-1` | 2024-01-02 (launch) | active |
| Bob | `m-1` | 2024-01-05 | 2024-02-01 |
| Cy | `m-2` | 2024-01-05 | active |

## Changes

## 2024-01-02

- **[Tools / Memory]** Added a **new** command,
  which remembers
- A plain line

## 2024-01-03 to 2024-01-09 (winter hours)

- [Other] Shorter weekends

## Elsewhere

- not a change
"""


def _written(s, text: str):
    """The text as a file of the shared folder, read whole."""
    path = f"{shared_dir(s)}/log-{uuid.uuid4().hex}"
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return s.read.text(path, wholetext=True)


def src11(s, d):
    """A change log in Markdown as typed rows. A file is one row, and is parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for t in pdf["value"] for r in markdown.change_log(t)], columns=["entry_id", "date_start", "date_end", "note", "tags", "categories", "text", "affects_schedule"])

    got = _written(s, LOG).mapInPandas(run, "entry_id string, date_start date, date_end date, note string, tags array<string>, categories array<string>, text string, affects_schedule boolean")
    return got.withColumn("tags", F.array_join("tags", ",")).withColumn("categories", F.array_join("categories", ","))


SRC11 = """
SELECT * FROM (VALUES ('2024-01-02-1', DATE '2024-01-02', DATE '2024-01-02', NULL, 'Tools,Memory', 'tool,memory', 'Added a new command, which remembers', false),
 ('2024-01-02-2', DATE '2024-01-02', DATE '2024-01-02', NULL, '', 'other', 'A plain line', false),
 ('2024-01-03-1', DATE '2024-01-03', DATE '2024-01-09', 'winter hours', 'Other', 'schedule', 'Shorter weekends', true)) t(entry_id, date_start, date_end, note, tags, categories, text, affects_schedule)"""


def src12(s, d):
    """The roster in the same file, as arrivals and departures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**r, "categories": ",".join(r["categories"])} for t in pdf["value"] for r in markdown.roster_changes(markdown.roster(t))]
            yield pd.DataFrame(rows, columns=["date_start", "name", "change", "categories"])

    return _written(s, LOG).mapInPandas(run, "date_start date, name string, change string, categories string")


SRC12 = """
SELECT * FROM (VALUES (DATE '2024-01-02', 'Ann', 'joined', 'roster,model'), (DATE '2024-01-05', 'Bob', 'joined', 'roster'), (DATE '2024-01-05', 'Cy', 'joined', 'roster,model'), (DATE '2024-02-01', 'Bob', 'left', 'roster')) t(date_start, name, change, categories)"""


def src20(s, d):
    """A stage kept by its inputs: made once, found again, and made anew for another version."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    make = lambda: o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    run = uuid.uuid4().hex  # so that each call of this query begins without a cache
    one, first = cached("orders", f"{run}-1", [o], make)
    two, second = cached("orders", f"{run}-1", [o.orderBy(F.desc("o_orderkey"))], make)
    _, third = cached("orders", f"{run}-2", [o], make)
    return one.join(two.select("o_orderstatus", F.col("n").alias("n_again")), "o_orderstatus").select("o_orderstatus", "n", "n_again", "total", F.lit(f"{first},{second},{third}").alias("found"))


# ---------------------------------------------------------------- report columns, densities, order, sessions


def f36(s, d):
    """Log density of each value under Student's t of five degrees around 50, with a scale of 20."""
    run = F.pandas_udf(lambda x: pd.Series(student_t_logpdf(x.to_numpy(float), 5.0, 50.0, 20.0)), "double")
    return table(s, d, "events").select("event_id", F.round(run("value"), 6).alias("logpdf"))


def f39(s, d):
    return encode.profile(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey").cast("string")).alias("nation")))


F39 = """
WITH c AS (SELECT unnest([{'c': 'c_custkey', 't': 'integer', 'v': CAST(c_custkey AS VARCHAR)}, {'c': 'c_name', 't': 'text', 'v': c_name}, {'c': 'c_mktsegment', 't': 'text', 'v': c_mktsegment}, {'c': 'nation', 't': 'text', 'v': CASE WHEN c_nationkey % 5 > 0 THEN CAST(c_nationkey AS VARCHAR) END}]) AS x FROM customer),
     n AS (SELECT x.c AS "column", x.t AS "type", x.v AS v, count(*) AS n FROM c GROUP BY 1, 2, 3),
     g AS (SELECT "column", "type", CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_null, count(v) AS n_values, sum((length(v) + 3) * n) AS plain, sum(length(v) + 3) AS words, sum(n) AS rows FROM n GROUP BY 1, 2)
SELECT "column", "type", n_null, n_values, "type" = 'text' AND words + (length(CAST(n_values AS VARCHAR)) + 1) * rows < plain + 5 * n_null AS coded FROM g"""


def s06(s, d):
    """Run blocks of users by Spark's own sessions, cut at dates: the last row's time is the end, not the session's."""
    t = F.col("ts").cast("timestamp")
    g = table(s, d, "events").select("user_id", t.alias("t")).groupBy("user_id", F.to_date("t").alias("date"), F.session_window("t", "900 seconds")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_rows"))
    return g.select("user_id", "date", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_rows")


def o02(s, d):
    """A join that keeps the left side's order, by a key of that order which goes along; ties stay as they came."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    kinds = e.groupBy("event_type").agg(F.count("*").alias("n"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_type", "event_id"))
    return e.withColumn("pos", pos).join(kinds, "event_type", "left").select("user_id", "pos", "event_id", "n")


# ---------------------------------------------------------------- touches of turns

GAP = 21600.0


def turns(s, d):
    """Events as turns at a screen: visits, typed sentences, keys, clicks and commands; a date of a user is a session."""
    e = table(s, d, "events")
    kind = F.col("event_type")
    n = F.col("event_id").cast("string")
    url = F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example.net/p"), (F.col("event_id") % 5).cast("string"))
    text = (
        F.when(kind == "view", url).when(kind == "signup", F.concat(F.lit("This is one whole sentence of more than a dozen words, of the number "), n, F.lit(".")))
        .when(kind == "error", F.when(F.col("event_id") % 2 == 0, "Ctrl+S").otherwise("ctrl+l")).when(kind == "click", F.when(F.col("event_id") % 3 == 0, "Save draft").otherwise("Open menu"))
        .otherwise(F.concat(F.lit("cd /srv/app && cat a"), n, F.lit(".txt > b"), n, F.lit(".txt")))
    )
    action = F.when(kind.isin("view", "signup"), "type").when(kind == "error", "key").when(kind == "click", "click").otherwise("bash")
    return e.select(F.col("user_id").alias("actor"), F.to_date("ts").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), text.alias("text"))


def dg01(s, d):
    return desk.session_touches(turns(s, d), GAP).select(F.col("seq").alias("event_id"), "mode", "ref", "rule")


TOUCHES = f"""
WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS session, epoch_us(ts) / 1e6 AS t, 'https://h' || user_id % 7 || '.example.net/p' || event_id % 5 AS url FROM events),
     s AS (SELECT user_id, session, min(t) AS a, max(t) AS b FROM e GROUP BY 1, 2),
     c AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY session) <= {GAP} THEN 0 ELSE 1 END AS cut FROM s),
     i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS island FROM c),
     f AS (SELECT e.*, island, last_value(CASE WHEN event_type = 'view' THEN url END IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS focus,
                  last_value(CASE WHEN event_type = 'view' THEN url END IGNORE NULLS) OVER (PARTITION BY user_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS own FROM e JOIN i USING (user_id, session)),
     w AS (SELECT *, CASE event_type WHEN 'signup' THEN 'type' WHEN 'error' THEN 'key' ELSE 'click' END AS rule FROM f WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 0) OR (event_type = 'click' AND event_id % 3 = 0)),
     x AS (SELECT event_id, 'read' AS mode, url AS ref, 'visit' AS rule FROM e WHERE event_type = 'view'
           UNION ALL SELECT event_id, 'write', coalesce(focus, ''), rule || CASE WHEN own IS NOT NULL THEN '' WHEN focus IS NOT NULL THEN '_carried' ELSE '_gap' END FROM w
           UNION ALL SELECT event_id, unnest(['read', 'write', 'read']), unnest(['/srv/app', '/srv/app/b' || event_id || '.txt', '/srv/app/a' || event_id || '.txt']), unnest(['shell_cd', 'shell_redirect', 'shell_read']) FROM e WHERE event_type = 'purchase')"""


def dg09(s, d):
    return desk.focus_guesses(desk.session_touches(turns(s, d), GAP))


DG09 = TOUCHES + """,
     k AS (SELECT w.event_id, w.user_id, w.t, w.own AS ref, arg_max(v.url, (v.t, v.event_id)) AS last_session FROM w JOIN i USING (user_id, session) LEFT JOIN f v ON v.user_id = w.user_id AND v.t < i.a AND v.event_type = 'view' WHERE w.own IS NOT NULL GROUP BY 1, 2, 3, 4),
     n AS (SELECT k.event_id, v.url, count(*) AS n FROM k JOIN e v ON v.user_id = k.user_id AND v.event_type = 'view' AND (v.t, v.event_id) < (k.t, k.event_id) GROUP BY 1, 2),
     u AS (SELECT event_id, min(url) AS usual FROM (SELECT *, max(n) OVER (PARTITION BY event_id) AS most FROM n) WHERE n = most GROUP BY 1),
     g AS (SELECT ref, 'last_session' AS rule, last_session AS guess FROM k UNION ALL SELECT ref, 'usual', usual FROM k JOIN u USING (event_id))
SELECT rule, count(*) AS n, count(*) FILTER (ref = guess) AS "right" FROM g WHERE guess IS NOT NULL GROUP BY 1"""


QUERIES = {
    "SRC-11_change_log": (src11, SRC11),
    "SRC-12_roster": (src12, SRC12),
    "SRC-20_stage_cache": (src20, "SELECT o_orderstatus, count(*) AS n, count(*) AS n_again, round(sum(o_totalprice), 2) AS total, 'False,True,False' AS found FROM orders GROUP BY 1"),
    "S-06_session_window": (s06, f'SELECT user_id, date, start, "end", n_rows FROM ({BLOCKS_SQL})'),
    "O-02_kept_order": (o02, "WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS INT) AS pos, event_id, n FROM events JOIN k USING (event_type)"),
    "F-02_candidates": _pair(CANDIDATES, _candidates),
    "F-04_host_references": _pair(HOSTS, refs.reference),
    "F-05_paths": _pair(PATHS, refs.normalize_path),
    "F-06_trailing": _pair(TRAILING, refs.strip_trailing),
    "F-07_secrets": _pair(SECRETS, _secret),
    "F-11_canonical_values": _pair(VALUES, _values),
    "F-12_context_keys": _pair(CONTEXTS, _context),
    "F-27_typed_kinds": _pair(TYPED, desk.typed_kind),
    "F-28_artifacts": _pair(ARTIFACTS, _artifact),
    "F-29_containers": _pair(CONTAINERS, _container),
    "F-36_student_t": (f36, "SELECT event_id, round(lgamma(3.0) - lgamma(2.5) - 0.5 * ln(CAST(5 AS DOUBLE) * pi() * 400) - 3.0 * ln(1 + (value - 50) * (value - 50) / CAST(2000 AS DOUBLE)), 6) AS logpdf FROM events"),
    "F-39_column_profile": (f39, F39),
    "F-40_to_html": _pair(PAGES, markdown.to_html),
    "DG-01_session_touches": (dg01, TOUCHES + "\nSELECT event_id, mode, ref, rule FROM x"),
    "DG-09_focus_guesses": (dg09, DG09),
}
