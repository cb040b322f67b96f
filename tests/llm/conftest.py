import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, stems=("an", "the", "er", "ing", "tion", "re", "st", "ou", "ly", "ed")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """id and text: prose, copies, near copies, shared passages, blanks, nulls, a very long text."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    out = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    out += [(60 + i, out[i][1]) for i in range(6)]
    out += [(70 + i, f"{prose(rng, 40)} {passage}\n{prose(rng, 30)}") for i in range(5)]
    for i in range(6):
        words = out[20 + i][1].split()
        words[len(words) // 2] = "changed"
        out.append((80 + i, " ".join(words)))
    out += [(90, None), (91, ""), (92, " \t\n "), (93, "one"), (94, "one two"), (95, prose(rng, 5000)), (96, "a " * 300), (97, " ".join(["x y z"] * 80)), (98, "é̈ ß 日本 naïve\x0bform\x0cfeed\xa0nbsp")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with rows of null id, a repeated row, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in texts]
    rows += [(None, texts[0][1], "en", "s0", 1), (None, None, None, None, None), rows[0]]
    from pyspark.sql import functions as F

    clash = {n: F.lit(1) for n in ("h", "w1", "f", "key", "u", "v", "score", "kept", "length", "tail", "ids", "id", "a", "pos", "_d", "_tx", "_starts", "_whole", "_x", "_o", "_stats", "_judged", "_toxicity", "_g", "_m", "_c", "_n", "_s", "_q")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
