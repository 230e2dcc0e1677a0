"""Small tables with odd rows, shared by the operators' tests."""

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: extra columns whose names clash with what operators use inside
EXTRA = ", rid int, fp string, padded string, row int, h int, ids int, label string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    """Null, empty, blank, tiny, long and repeated texts, and near copies."""
    base = words(300, 1)
    near = base.split()
    near[150] = "changed"
    return [
        None, "", " \n\t ", "one", "One two", base, base, " ".join(near), words(60, 2) + "\n" + words(60, 3) + "\n" + words(60, 2), "É" * 300 + " é " * 120,
        "ab " * 4000, words(30_000, 4), "x", "x", "line of words here\n" * 30, words(80, 5) + " " + base[:600], "日本語 テキスト 😀 " * 40,
    ]


def table(spark, texts, extra=True, **columns):
    """documents with lang, source and clashing extra columns."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), *((1, "q", "z", 2, 3, 4, "l") if extra else ())) for i, t in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + (EXTRA if extra else "")
    return spark.createDataFrame(rows, ddl)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
