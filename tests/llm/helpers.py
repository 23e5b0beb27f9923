"""Made-up prose and plain forms of the contracts, for comparison."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400, tag: str = "w") -> str:
    return " ".join(f"{tag}{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, odd white space, nulls, empty and very long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(60)]
    passage, line = prose(rng, 60, tag="p"), "A line that is found in many documents, really."
    for i in range(0, 40, 4):
        texts[i] += f"\n {line.upper() if i % 8 else line}\t\n" + passage
    near = texts[7].split() + prose(rng, 200, tag="n").split()
    for _ in range(12):
        other = list(near)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = rng.choice("abc")
        texts.append(" ".join(other))
    texts += [texts[5]] * 15 + ["", " \n\t", "one", "One two", "la " * 50, "x " + "la " * 30 + "y", "a  b c\x1fd\r\ne", prose(rng, 9000)]
    rows = [(i * 3, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return [*rows, (100_000, None, None, None, None), (None, texts[5], "en", None, 1)]


def frame(spark, rows=None, extra: bool = True):
    """The corpus as a table, with columns whose names operators use themselves."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    if not extra:
        return df
    from pyspark.sql import functions as F

    names = ("n_lines", "n_words", "shard", "slot", "score", "component_id", "h", "__x", "size", "lang_pred", "predicted")
    return df.withColumns({n: F.lit("clash") for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().split()]


def smallest_reachable(ids, pairs):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
