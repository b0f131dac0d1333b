import random

import pytest

SCHEMA = "doc_id long, text string, lang string, t long, h string, score double, block int, spans string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, overlaps, shared passages, nulls, ties, repeated rows, one long text."""
    a, b, passage = words(1, 120), words(2, 90), words(3, 70)
    rows = [
        (10, a), (11, a), (12, a.replace(" ", "\n", 3)), (13, a + " extra words at the end"), (14, " ".join(a.split()[:60] + ["changed"] + a.split()[61:])),
        (3, b), (20, b.upper()), (21, words(4, 30) + " " + passage + " " + words(5, 30)), (22, passage), (23, words(6, 10) + "\t" + passage),
        (30, None), (31, ""), (32, "  \n "), (33, "one"), (34, "one two three"), (35, "One TWO three"), (40, "é" * 700), (41, "ab" * 500), (42, words(7, 51) + " " + words(7, 51)),
        (50, words(8, 3000) + " " + passage + " " + words(9, 3000)), (60, words(10, 80)), (60, words(10, 80)), (61, words(10, 80)), (60, words(11, 80)), (None, words(12, 80)), (None, words(12, 80)), (None, None), (70, words(12, 80)), (-5, passage),
    ]
    base = words(20, 150).split()
    r = random.Random(5)
    for i in range(60):  # near copies of each other in varying degree
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 99)}"
        rows.append((100 + i, " ".join(w)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with further columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(d, t, None, 7, None, 0.5, 1, "x", len(t or "")) for d, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows).repartition(3)


def tuples(df, *names) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
