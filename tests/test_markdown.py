from notarium.functions import markdown as md

NOTE = """---
title: Replication notes
status: open
tags: [net, "state"]
aliases:
- repl
- sync
---
# Replication notes

The intro goes
over two lines.

## Design

```python
# not a heading
```

### Details

Some text.
"""


def test_note():
    x = md.parse("net/x.md", NOTE)
    meta = dict(x["meta"])
    assert x["title"] == "Replication notes"
    assert meta["tags"] == ["net", "state"] and meta["aliases"] == ["repl", "sync"] and meta["status"] == ["open"]
    assert x["lead"] == "The intro goes over two lines."
    assert x["headings"] == ["Replication notes", "  Design", "    Details"]
    assert [(b, n) for b, n, _ in x["sections"]] == [("Replication notes", 11), ("Replication notes > Design", 16), ("Replication notes > Design > Details", 22)]


def test_title_falls_back():
    assert md.parse("dir/my-note.md", "plain")["title"] == "my-note"
    assert md.parse("a.b/name", "x")["title"] == "name"
    assert md.parse("x.md", "```\n# in code\n```")["title"] == "in code"
    assert md.parse("x.md", "---\ntitle: \"\"\n---\n# H")["title"] == "H"


def test_long_table_is_split():
    text = "# T\n\n" + "\n".join(["| some | cells | of a table row |"] * 200)
    out = md.parse("t.md", text)["sections"]
    assert len(out) >= 2 and all(len(b) <= 3100 for _, _, b in out)
    assert out[0][1] == 3


def test_one_long_line_stays_whole():
    assert len(md.parse("t.md", "w " * 10_000)["sections"]) == 1


def test_fences_are_never_cut():
    text = "```\n" + "code line\n\n" * 500 + "```\n\nafter"
    out = md.parse("t.md", text)["sections"]
    assert out[0][2].endswith("```") and out[1][2] == "after"


def test_frontmatter_rules():
    fm = lambda *lines: md.frontmatter(list(lines))
    assert fm("---", "a: 1") == ({}, 0)
    assert fm("x", "---", "a: 1", "---") == ({}, 0)
    assert fm("﻿---", "a: 1", "---") == ({}, 0)
    assert fm("---", "A: one", "- two", "---") == ({"a": ["one", "two"]}, 4)
    assert fm("---", "a: 1", "a:", "b: [x, , 'y, z']", "---") == ({"a": [], "b": ["x", "'y", "z'"]}, 5)
    assert fm("---", "# c: 1", ": no", "k: v # note", "  nested: 2", "---") == ({"k": ["v # note"], "nested": ["2"]}, 6)
    assert fm("---", "k: \"q", "l: 'q'", "---") == ({"k": ["\"q"], "l": ["q"]}, 4)


def test_headings():
    assert md.heading("## C#") == (2, "C")
    assert md.heading("## Foo ## ") == (2, "Foo ##")
    assert md.heading("##\tTab") == (0, "") and md.heading(" # x") == (0, "") and md.heading("####### x") == (0, "") and md.heading("#") == (0, "")


def test_breadcrumbs_of_skipped_levels():
    text = "### Deep\na\n# Top\nb\n### Skip\nc\n## Two\nd"
    assert [b for b, _, _ in md.parse("x.md", text)["sections"]] == ["Deep", "Top", "Top > Skip", "Top > Two"]


def test_lead_rules():
    lead = lambda t: md.parse("x.md", t)["lead"]
    assert lead("text\n## H\nmore\n\nrest") == "text more"
    assert lead("| t |\n> q\n\n- item\nnext") == "- item next"
    assert lead("x" * 500) == "x" * 400 + "…"
    assert lead("```\ncode\n```\nprose") == "prose"


def test_only_crlf_pairs_are_line_ends():
    assert md.parse("x.md", "# A\r\nb\rc")["sections"] == [("A", 2, "b\rc")]


def test_empty_section_gives_no_chunk():
    assert md.parse("x.md", "# A\n\n## B\n\n\n")["sections"] == []
