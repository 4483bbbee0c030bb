"""Brute-force versions and small tables for the tests of this folder."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD_TEXTS = [
    None, "", " \n\t ", "a", "one two", "One TWO three", "é ß ñ 日本 ☃", "x" * 5000, "word " * 9000, "tab\tand\x0bother\x0cgaps\r\n", "same text here twice over",
    "same text here twice over", "ends with space ", "  two  spaces  ", "nbsp\u00a0inside and \u2003wide", "null\x00byte", "<|endoftext|> it's 'tis 1234 don'LL", "\n\n\nlines\n\n",
]


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts=ODD_TEXTS):
    """Texts as documents, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or ""), i, f"k{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, start string")


def empty(spark):
    return frame(spark, ["x"]).limit(0)
