"""Small tables with every odd case, for all training-data operators."""

from __future__ import annotations

import random

CLASH = ("row", "name", "level", "key", "cls", "n", "kept", "ids", "score", "norm", "block", "found", "spans", "start", "comp", "group_size", "label", "at")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


BASE = words(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (None, "a text without an id, mail x.y@example.org now"), (1, None), (2, ""), (3, " \n\t "), (4, "long " + words(2, 60_000)), (5, BASE), (6, BASE.replace(" ", "  ")), (6, BASE.replace(" ", "  ")),
    (7, NEAR), (8, "one"), (9, "ONE\n"), (10, "call +1 (650) 555-0199, card 4111 1111 1111 1111, host 10.0.0.255 or 10.0.0.256"), (11, "x" * 30_000), (12, "日本語 テキスト 😀 é́"), (12, words(3, 30)), (None, None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en" if k % 2 else "de", f"s{k % 3}", None) + (None,) * (len(CLASH) - 1) + ("z",) for k, (i, t) in enumerate(rows)], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
