"""What actors type at a screen: kinds of typed text, keys of artifacts, and the touches of a session's turns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import refs
from eventloom.functions.shell import Shell

_COMMAND = re.compile(r"^\s*(?:\$ )?(?:sudo )?(?:cd|ls|cat|echo|mkdir|rm|cp|mv|touch|git|gh|glab|curl|wget|pip3?|npm|python3?|node|bash|sh|chmod|grep|sed|awk|find|tar|ssh|export|source|make|docker)(?:\s|$)")
_OPERATORS = re.compile(r"\s(?:&&|\|\||>>?)\s|\s\|\s|\$\(")
_SECRET = re.compile(r"(?i)\*{4,}|\[redacted\]|\bpassword\s*[:=]|^(?=.*[0-9])(?=.*[a-z])(?=.*[^\w\s])\S{8,40}$")
_CODE = re.compile(r"(?:^|\n)\s*(?:def|class|import|from|function|const|let|var|return|if|for|while)\b|[{};]\s*(?:\n|$)|=>|</?\w+>|\(\)|==|\+=")
_OPERATOR_OF_SEARCH = re.compile(r"(?i)\b(?:from|to|subject|in|is|has|after|before|site|filetype):\S")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_ADDRESS = re.compile(r"(?i)^(?:https?://|file://|view-source:|www\.|localhost(?::\d+)?(?:/|$)|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|io|dev|edu|gov|co|app)(?:[/:?#]|$))")
#: Kinds that leave nothing in a document.
PASSING = frozenset(("shell", "credential", "url", "search", "short_input"))


def typed_kind(text: str | None, address_bar: bool = False, search_box: bool = False, secret_box: bool = False) -> str:
    """shell, credential, url, code, search, short_input, form_field, prose or other: the first that fits; empty text is other."""
    t = (text or "").strip()
    if not t:
        return "other"
    lines = [x for x in t.split("\n") if x.strip() and not x.lstrip().startswith("#")] or [t]
    words = t.split()
    commands = sum(bool(_COMMAND.match(x) or _OPERATORS.search(x)) for x in lines)
    if 2 * commands >= len(lines) and commands and not (len(words) > 12 and _SENTENCE.search(t) and not _OPERATORS.search(t)):
        return "shell"
    if secret_box or (len(words) == 1 and _SECRET.search(t) and not _ADDRESS.match(t)):
        return "credential"
    if len(words) <= 2 and any(_ADDRESS.match(w) for w in words):
        return "url"
    if len(_CODE.findall(t)) >= 2:
        return "code"
    if len(lines) == 1 and ((len(words) <= 12 and (address_bar or search_box)) or (len(words) <= 8 and _OPERATOR_OF_SEARCH.search(t))):
        return "search"
    if len(t) <= 2 or (len(words) == 1 and t.isalpha() and t.islower() and len(t) <= 12):
        return "short_input"
    if len(lines) == 1 and len(words) <= 4 and len(t) <= 40 and not _SENTENCE.search(t):
        return "form_field"
    return "prose" if len(words) >= 5 or _SENTENCE.search(t) else "other"


#: Folders that hold projects and are none themselves.
SHELVES = frozenset("work projects project repos repo git code src workspace dev documents desktop downloads sites tmp scratch build".split())
#: Hosts that are ways to things, not things; and hosts whose pages are another's for each account.
PASSAGES = frozenset("google.com bing.com duckduckgo.com accounts.google.com example.com example.org w3.org schema.org".split())
OWN_PAGES = frozenset("mail.google.com calendar.google.com drive.google.com docs.google.com photos.google.com".split())
_LOCAL = re.compile(r"^(?:localhost|127\.[\d.]+|0\.0\.0\.0|10\.[\d.]+|192\.168\.[\d.]+)(?::\d+)?$")


def container(path: str, roots: frozenset[str] = frozenset()) -> str:
    """The project folder of a path: the deepest known root above it, else the first folder of its own, below shelves."""
    parts = path.split("/")
    for n in range(len(parts), 0, -1):
        if "/".join(parts[:n]) in roots:
            return "/".join(parts[:n])
    n = 2 if path.startswith("~") else 4 if re.match(r"/(?:home|Users|mnt|media)/", path) else 3
    if len(parts) > n and parts[n - 1].lower() in SHELVES:
        n += 1
    return "/".join(parts[:n])


def artifact(ref: str, actor: str, roots: frozenset[str] = frozenset()) -> tuple[str, str, str] | None:
    """(key, container, kind) of a reference; None for what is no artifact. Local things are their actor's own."""
    if ref.startswith("doc:"):
        return ref, ref, "doc"
    if ref.startswith("code:"):
        return ref, ref.partition("#")[0], "code"
    if ref.startswith(("/", "~")):
        if ref.startswith("~/."):
            return None
        return f"local:{actor}:{ref}", f"local:{actor}:{container(ref, roots)}", "local"
    if "://" not in ref:
        return None
    host, _, path = ref.split("://", 1)[1].split("?")[0].partition("/")
    host, path = host.removeprefix("www."), path.strip("/")
    if _LOCAL.match(host):
        return f"local:{actor}:{host}/{path}", f"local:{actor}:{host}", "local"
    if host in OWN_PAGES:
        return (k := f"local:{actor}:{host}/{path}"), k, "local"
    if host in PASSAGES or not path:
        return None
    return (k := f"url:{host}/{path}"), k, "url"


SAVES = frozenset(("ctrl+s", "ctrl+v", "ctrl+x", "delete", "backspace"))
TO_ADDRESS = frozenset(("ctrl+l", "f6", "alt+d"))
_PRESSES = re.compile(r"(?i)\b(?:save|submit|send|post|publish|share|delete|create|upload|confirm)\b")


@dataclass
class Desk:
    """An actor at work: a shell for each session, what is in focus, and what was in focus when the session before ended."""

    gap_s: float
    shell: Shell = field(default_factory=Shell)
    session: object = None
    focus: str | None = None
    carried: str | None = None
    ended: float = float("-inf")
    address: int = 0  # turns for which the address bar may still have the focus

    def turn(self, session: object, ts: float, action: str | None, text: str | None) -> list[tuple[str, str, str]]:
        """(mode, reference, rule) of what a turn touches: read, write or mention."""
        if session != self.session:
            held = self.focus or self.carried
            self.carried = held if ts - self.ended <= self.gap_s else None
            self.session, self.focus, self.shell, self.address = session, None, Shell(), 0
        self.ended = ts
        text = text or ""
        out: list[tuple[str, str, str]] = []
        if action == "bash":
            out += [(mode, (refs.reference(what) or what) if "://" in what or what.startswith("git@") else what, f"shell_{rule}") for mode, what, rule in self.shell.run(text)]
        elif action == "type":
            kind = typed_kind(text, address_bar=self.address > 0)
            where = refs.extract(text if "://" in text else f"https://{text.strip()}") if kind == "url" else []
            self.address = 0
            if where:
                self.focus = where[0]
                out.append(("read", where[0], "visit"))
            elif kind == "shell":
                out += [(mode, what, f"typed_{rule}") for mode, what, rule in self.shell.run(text)]
            elif kind not in PASSING:
                out += self._write("type")
                out += [("mention", r, "typed") for r in refs.extract(text)]
        elif action == "key":
            key = text.strip().lower().replace(" ", "")
            if key in SAVES:
                out += self._write("key")
            self.address = 4 if key in TO_ADDRESS else self.address
        elif action == "click" and _PRESSES.search(text):
            out += self._write("click")
        elif action in ("message", "search"):
            out += [("mention", r, action) for r in refs.extract(text)]
        self.address = max(0, self.address - 1)
        return out

    def _write(self, rule: str) -> list[tuple[str, str, str]]:
        """A write without a focus goes to the one carried over; without that it is a gap."""
        at = self.focus or self.carried
        return [("write", at, rule if self.focus else f"{rule}_carried")] if at else [("write", "", f"{rule}_gap")]


TURN = ("actor", "session", "ts", "seq", "action", "text")


def session_touches(turns: DataFrame, gap_s: float = 3600.0) -> DataFrame:
    """(actor, session, ts, seq, mode, ref, rule) of turns (actor, session, ts, seq, action, text), in an actor's order.

    ts is in seconds. Actors are dealt out and sorted by Spark and pass as a stream, so what a task holds is one
    actor's state, however many turns there are. A null action or text touches nothing.
    """
    rows = turns.select(*TURN).repartition("actor").sortWithinPartitions("actor", "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, desk = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if desk is None or r.actor != who:
                    who, desk = r.actor, Desk(gap_s)
                out += [(r.actor, r.session, r.ts, r.seq, *t) for t in desk.turn(r.session, r.ts, r.action, r.text)]
            yield pd.DataFrame(out, columns=["actor", "session", "ts", "seq", "mode", "ref", "rule"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"actor {kinds['actor']}, session {kinds['session']}, ts double, seq {kinds['seq']}, mode string, ref string, rule string")


def focus_guesses(touches: DataFrame) -> DataFrame:
    """How well writes' places are guessed from what came before: for each rule of guessing, the writes that it has a guess for, and those it gets right.

    touches: session_touches' rows. Only writes whose place is known in their session count. last_session: the place
    that was in focus when the actor's session before ended; usual: the place that the actor has visited most so far,
    of several the least name.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("actor").orderBy("ts", "seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = touches.where("rule IN ('visit', 'type', 'key', 'click')").withColumn("place", F.when(F.col("rule") == "visit", F.col("ref")))
    # The state as each session begins is that after the last row of those before it.
    t = t.withColumn("so_far", F.last("place", ignorenulls=True).over(before))
    start = t.groupBy("actor", "session").agg(F.min(F.struct("ts", "seq", "so_far")).alias("m")).select("actor", "session", F.col("m.so_far").alias("last_session"))
    # Visits of each place so far, and of these the most, as running maxima: no list of visits is kept.
    visit = t.where("rule = 'visit'").withColumn("n", F.row_number().over(W.partitionBy("actor", "ref").orderBy("ts", "seq")))
    best = visit.withColumn("most", F.max("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # The set with the most visits changes where the maximum rises (one place) or is reached again (one more).
    level = W.partitionBy("actor", "most").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    best = best.withColumn("usual", F.min(F.when(F.col("n") == F.col("most"), F.col("ref"))).over(level)).select("actor", "ts", "seq", "usual")
    w = t.where("rule <> 'visit'").select("actor", "session", "ts", "seq", "ref", F.lit(None).cast("string").alias("usual"))
    both = w.unionByName(best.withColumn("session", F.lit(None).cast(w.schema["session"].dataType)).withColumn("ref", F.lit(None).cast("string")))
    seen = both.withColumn("usual", F.last("usual", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).where("ref IS NOT NULL")
    guessed = seen.join(start, ["actor", "session"], "left").select("ref", F.explode(F.create_map(F.lit("last_session"), "last_session", F.lit("usual"), "usual")).alias("rule", "guess"))
    return guessed.where("guess IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("ref") == F.col("guess")).alias("right"))
