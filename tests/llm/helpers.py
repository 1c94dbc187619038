import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    """(doc_id, text): copies, near copies, shared passages, repeated lines, nulls and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(30)]
    block = "\n".join(" ".join(word() for _ in range(5)) for _ in range(6))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 60, 150, 320]))]
        if i % 5 == 0 and rows and rows[-1][1]:
            words = WORD.findall(rows[-1][1])
            if words and i % 2:
                words[rng.randrange(len(words))] = word()
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        text = " ".join(words)
        if i % 6 == 0:
            text += "\n" + block
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, rows[7][1]), (n + 4, rows[7][1]), (None, "some text of a row without id"), (n + 5, "É é É é " * 20)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
