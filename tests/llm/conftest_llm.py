import hashlib
import random

import pytest

from slotwise.llm.arrays import SPACES  # noqa: F401  the package must import

DOC_TYPE = "doc_id long, text string, lang string, N_Words string"


@pytest.fixture(scope="session")
def corpus():
    """Small texts with nulls, empty and long ones, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(1, 7))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, short = words(60), words(35)
    rows, number = [], iter(range(0, 10_000))
    for n in (0, 1, 2, 4, 5, 6, 13, 17, 18, 34, 35, 36, 70, 200, 500):
        rows.append((next(number), " ".join(words(n))))
    base = words(120)
    for k in (0, 1, 3, 6, 12, 30):
        copy = list(base)
        for place in rng.sample(range(len(copy)), k):
            copy[place] = rng.choice(vocabulary)
        rows.append((next(number), " ".join(copy)))
    for _ in range(4):
        rows.append((next(number), "\n".join([" ".join(words(20)), " ".join(passage), " ".join(words(9))])))
    rows += [(next(number), " ".join(words(3) + short)), (next(number), " ".join(short + words(3)))]
    rows.append((next(number), " ".join(["again"] * 90)))  # overlaps its own repetition
    rows.append((next(number), " ".join(passage + passage)))
    rows.append((next(number), "  \t\n\r " + " ".join(words(40)) + " \x0b\x0c "))
    rows.append((next(number), "Été ÉCOLE été ".strip() + " naïve " * 12))
    rows.append((next(number), " ".join(words(8000))))  # long
    rows += [(next(number), None), (None, "no id at all"), (None, None), (next(number), "")]
    same = (next(number), " ".join(words(50)))
    rows += [same, same, (next(number), same[1])]  # repeated row, and a copy
    near = same[1].split()
    near[25] = "changed"
    rows.append((next(number), " ".join(near)))
    return [(i, t, "en", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_TYPE).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_TYPE)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    """Rows in a fixed order, for comparison."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
