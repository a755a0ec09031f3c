"""Brute-force versions and small fixtures."""

from __future__ import annotations

import re

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def odd_documents():
    """Null columns, empty, long and repeated texts, ties, other scripts."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s0"), (3, near, None, None), (4, None, None, None), (5, "", "en", "s1"), (6, " \t\n", "en", "s1"), (7,
            "one two", "en", "s2"), (8, "One two", "en", "s2"),
        (9, base + " " + base, "en", "s0"), (10, "É" * 50 + "\n" + "shared line of more than twenty chars\n", "fr", "s0"), (11,
            "shared line of more than twenty chars\nx", "fr", "s1"),
        (12, "  SHARED line of more than twenty chars\t\nshared line of more than twenty chars", "fr", None), (13,
            "漢字 かな <|endoftext|> 'tis it's 12½ ſ İ Σας", "ja", "s9"), (14, "long " * 20000, "en", "s0"), (None, "no id at all but some words here", "en", "s0"),
        (15, "tie", "en", "s1"), (15, "tie", "en", "s1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
