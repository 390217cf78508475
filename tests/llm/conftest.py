import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ["key", "id", "root", "score", "kept", "keep_id", "tokens", "carried", "wanted", "bucket", "_id", "_norm", "_dropped", "a.b"]


def _words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta"]) + str(rng.randint(0, 99)) for _ in range(n))


def awkward_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    base = _words(rng, 120).split(" ")
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "   \n\t ", "en", None, 5), (4, "one two", "de", "src1", 7), (5, "ONE two", "de", "src1", 7), (6, "Éé one", "fr", "zzz", 6), (7, "éé one", "fr", "zzz", 6),
            (8, _words(rng, 30_000), "en", "src0", 1), (None, "lost", "en", "src0", 4), (9, "repeated row", "es", "src2", 12), (9, "repeated row", "es", "src2", 12)]
    for k in range(20):
        text = list(base)
        for j in range(k % 5):
            text[(17 * j + 31 * k) % len(text)] = f"changed{k}x{j}"
        rows.append((100 + k, " ".join(text), "en", "src0", 700))
    rows += [(200 + k, _words(rng, rng.randint(1, 60)), rng.choice(["en", "de", "xx", None]), f"src{rng.randint(0, 30)}", 50) for k in range(60)]
    rows += [(300 + k, rows[40 + k][1].upper() if k % 2 else rows[40 + k][1], "en", "src5", 50) for k in range(20)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
