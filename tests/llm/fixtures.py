"""Small corpora with the awkward cases: nulls, blanks, long texts, ties, repeated rows, copies, near copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, block int, label string, words string, size long, n long, h string"


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnoéß日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = sentence(60)
    texts: list[str | None] = [None, "", "   \t\n", "one", "one two three four", "ONE two three four", sentence(9000), "x" * 60, "x" * 60 + " y"]
    texts += ["Released under the MIT License.", "licensed under the Apache License, version 2.0 and MIT\tlicense mit license", "GNU General Public License, version 3 mit  license"]
    for _ in range(n):
        texts.append(sentence(r.randint(5, 120)).capitalize())
    for _ in range(n // 2):
        base = r.choice([t for t in texts if t and 20 < len(t.split()) < 200])
        w = base.split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w) if r.random() < 0.8 else "  ".join(w) + "\n")
    for _ in range(8):
        texts.append(sentence(r.randint(3, 40)) + " " + passage + " " + sentence(r.randint(3, 40)))
    ids = list(range(3, 3 + 3 * len(texts), 3))
    r.shuffle(ids)
    rows = [(i, t, "en", r.choice(["a", "b", "c", "é", None, "big", "big", "big"]), len(t or ""), 0.5, True, 1, "x", "w", 9, 9, "h") for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[14], rows[14], rows[20], rows[0]]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(5)
