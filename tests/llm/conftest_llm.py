"""Helpers of the tests."""

import random

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, words: int = 900) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
