"""Brute-force versions of the dealt operators, over lists of (doc_id, text)."""

import os
import re

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empties, ties, repeats, short and odd texts.
ODD = [
    (5, None, None, None, None), (3, "", "en", "s", 0), (7, "one two three", "en", "s", 13), (8, "one two three", "fr", None, 13), (9, "  \n\t ", "en", "s", 5),
    (11, "Ünï çödé 😀 words   and\r\nlines here \x1c odd", "de", "s", None), (2, "x" * 5000, "en", "s", 5000), (1, "a b c d e f g h i j k l m n o p " * 40, "en", "s", 1), (12, "a b c d e f g h i j k l m n o p " * 40, "en", "s", 1),
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows(df, *keys):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple((r[k] is not None, r[k]) for k in keys))
