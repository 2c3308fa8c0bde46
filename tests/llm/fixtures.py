"""Small documents that hold every awkward case."""

import random

ODD = [None, "", " \n\t ", "one", "one two three four", "ÄÖ ß é 😀 x", "a" * 50_000, "x y " * 20_000, "Is onhe. " * 300]


def corpus(n=60, seed=5):
    """(doc_id, text): random words, exact and near copies, shared passages, odd texts, ties."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeiou" if k % 2 else "bcdfglmnrst") for k in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = say(70)
    texts = []
    for k in range(n):
        t = say(r.choice([3, 30, 80, 200]))
        if k % 5 == 1 and texts:
            t = r.choice(texts)
        elif k % 5 == 2 and texts:
            w = r.choice(texts).split()
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif k % 5 == 3:
            t = f"{t} {passage} {say(20)}"
        texts.append(t)
    texts += ODD
    return list(enumerate(texts))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def awkward(spark, rows):
    """The rows with repeats, rows without an id, and columns whose names clash with those of the operators."""
    more = rows + rows[:3] + [(None, "no id at all"), (None, None)]
    cols = ["score", "n", "cls", "words", "spans", "fp", "base", "tokens", "rate", "piece", "start", "length", "rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[None] * len(cols)) for i, t in more], schema)
