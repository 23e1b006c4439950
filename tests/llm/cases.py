"""Awkward rows shared by the operators' tests, and plain Python versions of what they compute."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id bigint, text string, source string, lang string, n_chars bigint, uid bigint, sha string, kept string, keep_id int, mark string, "
    "size string, k1 int, k2 int, body int, words int, row string, at string, score int, component string, n_words string, n int, best int, "
    "host int, path int, label string, segments int, template int, ids int, cuts int, url string, html string, `group` int")
WIDTH = len(SCHEMA.split(","))

PROSE = " ".join(f"word{i % 97} and thing{i % 89}" for i in range(120)) + "."


def awkward(spark, extra=()):
    """Null in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    texts = [
        (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, PROSE.upper(), "b"), (None, PROSE, None), (None, None, None),
        (4, None, "a"), (5, "", "b"), (6, " \n\t ", "b"), (7, "Ünïcode ÉÈ word", "ü"), (8, "ünïcode ÉÈ word", "ü"), (9, "x " * 60_000, "long"),
        (10, PROSE + " More of it here.", "b"), (11, "one two three", None), (12, "one two three", "c"), *extra,
    ]
    return spark.createDataFrame([(i, t, s, *[None] * (WIDTH - 3)) for i, t, s in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return [tuple(r) for r in df.select(*(names or df.columns)).collect()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, width):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, distance=4, linked=None):
    """For each place the list of places that links can reach."""
    linked = linked or (lambda a, b: (a ^ b).bit_count() <= distance)
    parent = list(range(len(marks)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(marks)):
        for j in range(i):
            if linked(marks[i], marks[j]):
                parent[top(i)] = top(j)
    tops = [top(i) for i in range(len(marks))]
    return [[j for j, t in enumerate(tops) if t == tops[i]] for i in range(len(marks))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    text = text or ""
    words = WORD.findall(text)
    grams, again = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            again |= {p + k for p in places for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    lost = total = 0
    for line in lines:
        own = WORD.findall(line)
        chars = sum(map(len, own))
        total += chars
        bad = len(own) < 8 and not re.search(r"[.!?:;…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*$", line)
        bad |= sum(bool(re.search(r"[!?#*$%&~^=_]{2,}$", w)) for w in own) > 0.3 * len(own)
        bad |= sum(bool(re.fullmatch(r"[|»«›‹·•>/\\-]+", w)) for w in own) > 0.2 * len(own)
        bad |= "all rights reserved" in line.lower()
        lost += chars * bad
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed,
            not failed and (not total or lost / total <= 0.5))
