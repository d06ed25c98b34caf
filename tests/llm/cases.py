"""Documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use inside.
EXTRA = {"__text": "'a'", "__th": "1", "__doc": "2", "th": "3", "keep": "4", "kept": "5", "spans": "6", "rules": "7", "w": "8", "l": "9", "fp": "10", "grp": "11", "shard": "12", "curve": "13", "score": "14", "quality": "15", "__gone": "16", "words": "17", "key": "18"}


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    base = [prose(rng.randint(15, 90)) for _ in range(30)]
    shared = "This very line is found in many of the documents."
    out: list[str | None] = [None, "", " ", "\n", "\n\n \t\n", "one", "ONE", "a b", "éÉK \U0001f600 ▁▁x"]
    out += base
    out += [base[0], base[0], base[1] + " extra", base[1].upper()]
    out += [f"{b}\n  {shared}\t\n{prose(12)}\n{shared.lower()}" for b in base[:6]]
    out += ["\n".join([shared] * 5), "heat " * 60, ("same eight words come here again and again " * 9).strip()]
    out += [" ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in prose(60).split()), prose(50).upper().replace(" ", "!! ")]
    out += [prose(9000), "x" * 30000, "\n".join(prose(6) for _ in range(400))]
    return out


def documents(spark, extra: bool = False):
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 7 == 0 else f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[12], rows[12], (None, "no id at all, but a text", "en", "src0", 5), ((1 << 60) + 1, "a text of a large id, longer than a double holds", "en", "src1", 50), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in EXTRA.items()]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
