"""Text functions on made strings."""

from __future__ import annotations

import pytest

from eventloom.functions import anchors, refs
from eventloom.functions.shell import Shell, segments


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("see https://Example.com:443/a/?utm_source=x&b=1#top.", ["https://example.com/a?b=1"]),
        ("(https://h.org/a_(b)), https://h.org/a_(b)", ["https://h.org/a_(b)"]),
        ("https://github.com/Own/Name/issues/7 and git@github.com:Own/Name.git", ["code:github.com/own/name#issue:7", "code:github.com/own/name"]),
        ("https://docs.google.com/document/d/abcdefghij123/edit", ["doc:abcdefghij123"]),
        ("open /tmp/x/../a.txt or ~/b/c/ now", ["/tmp/a.txt", "~/b/c"]),
        ("https://h.org/{id} https://nohost/ a/b/c", []),
        ("https://h.org/p?token=abc&q=1", ["https://h.org/p?q=1"]),
        (None, []),
    ],
)
def test_references(text, found):
    assert refs.extract(text) == found


def test_redaction():
    assert refs.redact("x ghp_abcdefghijklmnop y") == "x *** y"
    assert refs.strip_trailing("a).") == "a" and refs.strip_trailing("(a)") == "(a)"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail a.b@c.org at 3 pm", [("email", "a.b@c.org"), ("time", "15:00")]),
        ("on March 5, 2024 or 2024-03-05 or 7 May", [("date", "2024-03-05"), ("date", "2024-03-05"), ("date", "-----05-07")]),
        ("$1.5 million, 20%, 1,234 and 7", [("money", "$1500000"), ("percent", "20%"), ("number", "1234"), ("number", "7")]),
        ("call +1 (499) 555-6503", [("phone", "+14995556503")]),
        ("https://h.org/2024 v2.1", [("url", "https://h.org/2024")]),
        ("", []),
    ],
)
def test_facts(text, found):
    assert [(k, v) for _, _, k, v in anchors.anchors(text)] == found


def test_segments():
    assert segments("a; b && c | d # e\nf 'x; y' \"z|w\" it's") == ["a", "b", "c", "d", "f 'x; y' \"z|w\" it's"]


def test_shell_keeps_its_place():
    s = Shell()
    s.run("cd /srv/app && ls")
    assert s.run("cat a.txt > ../b.txt") == [("write", "/srv/b.txt", "redirect"), ("read", "/srv/app/a.txt", "read")]
    assert s.run("cd sub; touch n 2>&1") == [("read", "/srv/app/sub", "cd"), ("write", "/srv/app/sub/n", "file_op")]
    assert s.run("cat <<'E' > n.txt\nrm all\nE") == [("write", "/srv/app/sub/n.txt", "heredoc")]
    assert s.run("curl -X POST https://h.org/p") == [("write", "https://h.org/p", "http")]
    assert s.run("git clone https://h.org/r.git") == [("read", "https://h.org/r.git", "git_clone")]
