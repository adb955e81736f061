"""References in free text: URLs, code hosts, documents and paths, in one form each, in order, each once."""

from __future__ import annotations

import hashlib
import hmac
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STOPS = r"""\s<>"'`\\|"""
_NAME = r"[\w.-]+"
#: What may be a reference, each alternative under its name; lookbehinds keep paths out of URLs and words.
CANDIDATE = re.compile(
    "|".join(
        (
            rf"(?P<url>(?i:https?)://[^{_STOPS}]+)",
            rf"(?P<bare>(?<![\w./@-])(?i:www\.{_NAME}|(?:github|gitlab)\.com|bitbucket\.org|(?:docs|drive|sheets|slides)\.google\.com)/[^{_STOPS}]*)",
            rf"(?P<remote>(?:ssh://)?git@{_NAME}[:/][\w./-]+)",
            rf"(?P<api>\b(?:gh|glab)\s+api\b[^\n;|&]*?[\s\"']/?(?:repos|projects)/[^{_STOPS}]+)",
            rf"(?P<named>\b(?:gh|glab)\s+repo\s+[a-z][a-z-]*\s+[\"']?{_NAME}(?:/{_NAME})+)",
            rf"(?P<option>\b(?:gh|glab)\b[^\n;|&]*?\s(?:-R|--repo)[\s=]+[\"']?[\w.:/-]+)",
            r"(?P<path>(?<![\w./~-])(?:~|\$HOME|\$\{HOME\}|\.\.?)?(?:/[\w.@+-]+)+)",
        )
    )
)
#: Folders at the top under which absolute paths name somebody's files; others are mostly routes of sites or the system's.
PATH_ROOTS = frozenset("home root tmp workspace workspaces mnt media opt srv var data app Users usr scratch".split())
_TRACKING = re.compile(r"^(?:utm_.*|ref|fbclid|gclid|v|cb|t|ts|_)$", re.I)
_SECRET = re.compile(r"^(?:token|key|api_?key|sig|signature|auth|access_token|password|secret)$", re.I)
_TOKENISH = re.compile(r"(?:gh[oprsu]_|github_pat_|glpat-|sk-|xox[abprs]-|AKIA|AIza)[A-Za-z0-9_-]{10,}|\beyJ[\w-]{10,}\.[\w-]{10,}(?:\.[\w-]*)?|\b[0-9a-f]{32,}\b")
#: Parts of names of parameters that hold something secret, and whole names that only look like it.
_SECRET_PART = re.compile(r"token|secret|passw(?:or)?d|apikey|accesskey|signature|credential|jwt|privatekey")
_NOT_SECRET = frozenset(("tokenid", "tokentype", "maxtokens", "tokenusage"))
_PORTS = {"http": ":80", "https": ":443"}
#: Hosts of code and of shared documents, and how much of their paths names a thing.
_CODE = {"github.com": 2, "gitlab.com": 2, "bitbucket.org": 2}
_SUBRESOURCES = {"issues": "issue", "work_items": "issue", "pull": "pull", "pulls": "pull", "merge_requests": "pull", "commit": "commit", "commits": "commit", "blob": "file", "raw": "file", "blame": "file", "tree": "tree", "wiki": "wiki", "releases": "release"}


def strip_trailing(s: str) -> str:
    """Without punctuation at the end, and without a bracket that the text before does not open."""
    while s:
        c = s[-1]
        if c in ".,;:!?*'\"":
            s = s[:-1]
        elif c in ")]}" and s.count(c) > s.count({")": "(", "]": "[", "}": "{"}[c]):
            s = s[:-1]
        else:
            break
    return s


def is_secret_param(name: str) -> bool:
    """Whether a parameter's name says that its value is secret; case, dashes and underlines do not matter."""
    plain = re.sub(r"[-_]", "", unquote(name).strip().lower())
    return plain not in _NOT_SECRET and bool(_SECRET.match(name) or _SECRET.match(plain) or _SECRET_PART.search(plain))


def redact(s: str) -> str:
    return _TOKENISH.sub("***", s)


def normalize_url(url: str) -> str | None:
    """One form of a URL: small scheme and host, no default port, fragment, tracking or secret parameters; None for templates."""
    m = re.match(r"(?i)(https?)://(?:[^/@\s]*@)?([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?", url)
    if not m or re.search(r"[{}<>$]|%7B", m[2] + m[3], re.I):
        return None
    scheme, host = m[1].lower(), m[2].lower()
    host = host.removesuffix(_PORTS[scheme]).rstrip(".")
    if "." not in host and not host.startswith("localhost"):
        return None
    kept = [p for p in (m[4] or "").split("&") if p and not _TRACKING.match(p.split("=")[0]) and not is_secret_param(p.split("=")[0])]
    return redact(f"{scheme}://{host}{m[3].rstrip('/')}" + ("?" + "&".join(kept) if kept else ""))


def _code(host: str, parts: list[str]) -> str | None:
    """code:host/owner/name[#kind:id] of the parts of a path on a host of code; groups in groups where a dash ends them."""
    parts = [unquote(p) for p in parts if p]
    if "-" in parts:
        at = parts.index("-")
        project, rest = parts[:at], parts[at + 1 :]
    else:
        at = next((i for i, p in enumerate(parts) if i >= 2 and p in _SUBRESOURCES), len(parts) if host == "gitlab.com" else 2)
        project, rest = parts[:at], parts[at:]
    if len(project) < 2:
        return None
    name = f"code:{host}/{'/'.join(project).lower().removesuffix('.git')}"
    if len(rest) >= 2 and rest[0] in _SUBRESOURCES:
        kind, tail = _SUBRESOURCES[rest[0]], rest[1:]
        if kind in ("file", "tree") and len(tail) > 1:
            tail = tail[1:]  # what comes after the branch
        if kind in ("issue", "pull") and not tail[0].isdigit():
            return name
        name += f"#{kind}:{tail[0] if kind in ('issue', 'pull', 'commit') else '/'.join(tail)}"
    return name


def _document(path: str, query: str) -> str | None:
    """doc:id of a shared document's or folder's address."""
    m = re.search(r"(?:/|^)(?:d(?:/e)?|folders)/([\w-]{10,})", path) or re.search(r"(?:^|&)id=([\w-]{10,})", query)
    return f"doc:{m[1]}" if m else None


def reference(candidate: str) -> str | None:
    """A candidate's reference: code:host/owner/name[#kind:id], doc:id, url, or path."""
    m = CANDIDATE.match(candidate)
    kind = m.lastgroup if m else "url"
    s = strip_trailing(candidate)
    if kind == "remote":
        host, path = re.split("[:/]", s.removeprefix("ssh://").removeprefix("git@"), maxsplit=1)
        return _code(host.lower(), [*path.removesuffix(".git").strip("/").split("/"), "-"])
    if kind in ("named", "option"):
        host = "gitlab.com" if s.startswith("glab") else "github.com"
        last = re.split(r"[\s=\"']+", s)[-1]
        if "://" in last or last.startswith("git@"):
            return reference(last)
        return _code(host, [*last.split("/"), "-"])
    if kind == "api":
        host, where = ("gitlab.com", "projects") if s.startswith("glab") else ("github.com", "repos")
        tail = s.split(f"{where}/", 1)[-1].split("?")[0]
        if host == "gitlab.com":
            first, _, more = tail.partition("/")
            return _code(host, [*unquote(first).split("/"), "-", *more.split("/")])
        return _code(host, tail.split("/"))
    if kind == "path":
        return normalize_path(s)
    url = normalize_url(s if "://" in s else f"https://{s}")
    if not url:
        return None
    host, _, path = url.split("://", 1)[1].partition("/")
    host = host.removeprefix("www.")
    path, _, query = path.partition("?")
    if re.fullmatch(r"(?:docs|drive|sheets|slides|forms)\.google\.com", host):
        return _document(path, query) or url
    if host in ("raw.githubusercontent.com", "api.github.com"):
        parts = path.split("/")
        if host[0] == "r" and len(parts) > 3:
            parts = [*parts[:2], "blob", *parts[2:]]
        return _code("github.com", parts[1:] if parts[0] == "repos" else parts) or url
    return (_code(host, path.split("/")) if host in _CODE else None) or url


def normalize_path(path: str) -> str | None:
    """A path without doubled or dotted parts, and no slash at its end; None if nothing is left of it.

    A home folder in a variable is ~. Absolute paths count only below PATH_ROOTS; a path that goes up from where it
    stands keeps its dots.
    """
    path = re.sub(r"^(?:\$HOME|\$\{HOME\})(?=/|$)", "~", path)
    lead = "~" if path.startswith("~") else "/" if path.startswith("/") else ""
    out: list[str] = []
    for p in path.split("/")[1 if lead else 0 :]:
        if p in ("", "."):
            continue
        if p == "..":
            if out and out[-1] != "..":
                out.pop()
                continue
            if lead:
                continue
        out.append(p)
    if not out or out[-1] == ".." or (lead == "/" and (len(out) < 2 or out[0] not in PATH_ROOTS)):
        return None
    return redact({"~": "~/", "/": "/", "": "" if out[0] == ".." else "./"}[lead] + "/".join(out))


def extract(text: str | None) -> list[str]:
    out: dict[str, None] = {}
    for m in CANDIDATE.finditer(text or ""):
        r = reference(m.group())
        if r:
            out[r] = None
    return list(out)


def _extracted(texts: pd.Series) -> pd.Series:
    seen: dict[str, str | None] = {}
    out = []
    for t in texts:
        mine: dict[str, None] = {}
        for m in CANDIDATE.finditer(t or ""):
            c = m.group()
            if c not in seen:
                seen[c] = reference(c)
            if seen[c]:
                mine[seen[c]] = None
        out.append(list(mine))
    return pd.Series(out)


def with_refs(df: DataFrame, text: str, name: str = "refs") -> DataFrame:
    """df with the references of each text. Texts without a slash do not go to Python: every candidate has one."""
    some = F.col(text).contains("/")
    return df.withColumn(name, F.when(some, F.pandas_udf(_extracted, "array<string>")(F.col(text))).otherwise(F.array().cast("array<string>")))


def ref_type(ref: Column) -> Column:
    return F.when(ref.startswith("code:"), F.when(ref.contains("#"), F.concat(F.lit("code_"), F.split_part(F.split_part(ref, F.lit("#"), F.lit(2)), F.lit(":"), F.lit(1)))).otherwise("code")).when(ref.startswith("doc:"), "doc").when(ref.startswith("http"), "url").otherwise("path")


def hash_owner(ref: Column, salt: str, keep: tuple[str, ...] = ()) -> Column:
    """A code reference with its owner replaced by a keyed pseudonym, unless the owner is on the list."""
    key = salt.encode()

    def run(refs: pd.Series) -> pd.Series:
        def one(r):
            m = re.match(r"(code:[^/]+/)([^/]+)(/.*)", r or "")
            if not m or m[2] in keep:
                return r
            return m[1] + "u_" + hmac.new(key, m[2].encode(), hashlib.sha256).hexdigest()[:12] + m[3]

        return refs.map(one)

    return F.pandas_udf(run, "string")(ref)
