"""Plain versions of the text definitions, one word at a time."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    t = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER) if lower else t)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


ODD_TEXTS = [
    None, "", " ", "\n\t ", "one", "One TWO", "a b c d", "a b c d e", "a b c d e f", "x " * 40, "ÀÉ ßö 你好 世界 ok",
    "line one is here today\nline one is here today\n\nline two", "a b c d e", "z" * 5000, "the quick brown fox jumps over the lazy dog again and again until dusk " * 30,
    " nbsp word", "é combining", "tab\tsep\x0bvt\x0cff\rcr", "😀 emoji 😀",
]
