"""Plain helpers of the tests."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [w for w in SPACE.split(text) if w]


def lower_words(text):
    return words_of((text or "").translate(LOWER))
