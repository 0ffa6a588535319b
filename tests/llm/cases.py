"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, node bigint, n bigint, count bigint"
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "sal", "dor", "vim") for c in ("a", "os", "ek")]


def passage(rnd, n):
    return " ".join(rnd.choice(VOCAB) + str(rnd.randrange(50)) for _ in range(n))


def rows(seed=0):
    rnd = random.Random(seed)
    texts = [None, "", " \n ", "one", "one", "ONE two", "a b c d"]
    base = passage(rnd, 60)
    texts += [base, base, base.upper(), base + " tail"]
    for k in (1, 3, 6):
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = passage(rnd, 60)
    texts += [passage(rnd, 20) + "\n" + shared + "\n" + passage(rnd, 20) for _ in range(3)]
    texts += ["\n".join([shared, "", passage(rnd, 5), shared]), passage(rnd, 20000), "x" * 200_000]
    out = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "p", 1, 2, 3) for i, t in enumerate(texts)]
    out += [out[7], out[0]]  # repeated rows
    out.append((2**60 + 1, "a large key", "en", "s1", 5, None, None, None, None))
    out.append((None, "without a key", "en", "s1", 5, None, None, None, None))
    return out


def frame(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
