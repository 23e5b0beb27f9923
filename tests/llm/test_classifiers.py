"""Language ID and quality: accuracy on held-out rows, and defined results at the edges."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, queries
from tests.llm.helpers import empty

SYLLABLES = {"aa": ["ba", "lo", "mi", "tun"], "bb": ["zer", "qué", "ñu", "ix"], "cc": ["ßto", "gri", "üve", "pf"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, sentence(rng, lang, rng.randint(4, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [5, 2, 1], k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id % 4 <> 2"))
    assert set(model.names) == set(SYLLABLES) and len({len(d) for d in model.dictionaries}) == 1
    long_ = sentence(rng, "aa", 60_000)
    odd = spark.createDataFrame([(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?!", None), (1003, long_, None), (1003, long_, None)], df.schema)
    out = langid.identify(df.union(odd).withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in out if r["doc_id"] < 1000 and r["doc_id"] % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in out if r["doc_id"] in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert {r["lang_pred"] for r in out if r["doc_id"] == 1003} == {"aa"}
    mixed = sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 30)
    margin = {r["doc_id"]: r["score"] for r in langid.identify(spark.createDataFrame([(1, mixed, None), (2, sentence(rng, "aa", 60), None)], df.schema), model).collect()}
    assert margin[1] < margin[2]
    nothing = langid.learn(empty(spark))
    assert nothing.names == () and langid.identify(df.limit(2), nothing).first()["lang_pred"] == "und"


def test_a_rare_language_costs_the_others_nothing(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.randint(4, 80)), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], [5, 2], k=400))]
    held, taught = rows[300:], rows[:300]
    for rare in ([("12 34 !", "dd")], [("lo ba", "cc")], [(sentence(rng, "cc", 30), "cc")], [(sentence(rng, "cc", 60), "cc") for _ in range(5)]):
        df = spark.createDataFrame(taught + [(1000 + i, t, lang) for i, (t, lang) in enumerate(rare)], "doc_id long, text string, lang string")
        model = langid.learn(df)
        assert len(model.dictionaries[model.names.index("aa")].lstrip(b"\0")) > 20_000 and "dd" not in model.names
        fresh = held + [(2000 + i, sentence(rng, "cc", 40), "cc") for i in range(20 if len(rare) > 1 else 0)]
        out = langid.identify(spark.createDataFrame(fresh, df.schema), model).collect()
        assert np.mean([r["lang"] == r["lang_pred"] for r in out if r["lang"] != "cc"]) > 0.97
        assert all(r["lang_pred"] == "cc" for r in out if r["lang"] == "cc")


def test_all_of_a_long_text_may_teach(spark):
    rng = random.Random(3)
    rows = [(i, "zz " * 200 + sentence(rng, lang, 200), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = spark.createDataFrame([(i, sentence(rng, lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in langid.identify(held, model).collect())


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        text, good = sentence(rng, "aa", rng.randint(5, 60)), int(rng.random() < 0.8)
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(text.split()), " ".join(w + "###" for w in text.split()), "ba " * 40])
        rows.append((i, text, "en", "s", 1))
        if i % 10:
            labels.append((i, good, 0))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "ba lo", "", "", 1), rows[0]]
    labels += [labels[0], (None, 1, 0), (3, None, 0), (5000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("predicted", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, lab.where("doc_id % 5 <> 0 OR doc_id IS NULL"))
    out = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    truth = {i: q for i, q, _ in labels if i is not None and q is not None and i % 5 == 0 and i < 1000}
    assert np.mean([out[i]["predicted"] == q for i, q in truth.items()]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert out[1000]["score"] == out[1001]["score"]
    untaught = quality.train(df, lab.limit(0))
    assert quality.score(df, untaught).count() == len(rows)


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    fresh = rng.uniform(size=(2000, 4))
    right = (model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) != (fresh[:, 1] > 0.5))
    assert right.mean() > 0.9 and (0, 1) in {(i, j) for i, j, *_ in model.pairs}


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables")
def test_queries_on_held_out_rows_of_the_driver_tables(spark):
    """Languages and quality labels that the queries' models never saw."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    lang = queries.op3_language_id(spark, TABLES).where("held_out").join(docs, "doc_id")
    right, n = lang.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n >= 0.985
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "quality")
    judged = [(r["score"], r["quality"], r["predicted"]) for r in queries.op9_quality_classifier(spark, TABLES).where("held_out").join(labels, "doc_id").collect()]
    assert len(judged) > 40 and sum(p == q for _, q, p in judged) / len(judged) >= 0.95
    good, bad = [s for s, q, _ in judged if q], [s for s, q, _ in judged if not q]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) >= 0.98
