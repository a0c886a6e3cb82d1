import random
import uuid

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def table(spark, tmp_path):
    """Writes rows (doc_id, text) with clashing extra columns as Parquet and reads them."""

    def make(rows, schema="doc_id long, text string, row_no string, n_words int, score double, spans string, kept string, size int"):
        names = [x.split()[0] for x in schema.split(", ")]
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame([(*r, *[None] * (len(names) - len(r))) for r in rows], schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def corpus():
    """Random texts with copies, near copies, repeats, nulls, empty, odd and long texts."""

    def make(seed, n=40):
        rng = random.Random(seed)
        texts = []
        for _ in range(n):
            kind = rng.random()
            if texts and kind < 0.15:
                t = rng.choice(texts)
            elif texts and kind < 0.5:
                w = (rng.choice(texts) or "x").split(" ")
                for _ in range(rng.randint(1, 3)):
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
                t = " ".join(w)
            else:
                t = " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 5, 30, 60, 90])))
            texts.append(t)
        texts += [None, "", None, " \n\t", "É ñ  漢字 😀", "a" * 5000, " ".join(WORDS * 200), "alpha  beta\tgamma\n", "alpha beta gamma", "ALPHA beta Gamma"]
        return list(enumerate(texts))

    return make


@pytest.fixture
def empty(table):
    return table([])
