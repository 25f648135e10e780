"""Texts for the tests of the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


#: null, blank and very long texts, repeated rows, equal ids with other texts, a null id
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, prose(5, 30000, 5000)),
    (6, prose(6, 60)),
    (6, prose(6, 60)),
    (7, prose(6, 60)),
    (8, prose(8, 40)),
    (8, prose(88, 40)),
    (None, prose(9, 40)),
    (None, None),
]
