"""The classifier on labelled prose: held-out junk and toxic texts go, trusted ones stay."""

import random

from tabaudit.llm import quality


def test_toxic_prose_and_junk_are_rejected(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    insults = ["idjit", "scamp", "rotter", "blighter"]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        kind = "toxic" if i % 6 == 0 else "junk" if i % 6 == 1 else "trusted"
        if kind == "toxic":
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(insults))
        if kind == "junk":
            words = [r.choice(vocabulary[:12])] * len(words)
        docs.append((i, " ".join(words), "en", kind))
        if i < 400:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string, kind string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    new = [row for row in got.collect() if row["doc_id"] >= 400]  # without labels
    share = {k: sum(row["accepted"] for row in new if row["kind"] == k) / sum(row["kind"] == k for row in new) for k in ("toxic", "junk", "trusted")}
    assert share["trusted"] >= 0.9 and share["toxic"] <= 0.05 and share["junk"] <= 0.05, share


def test_limits_come_from_all_held_out_rows(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(vocabulary[30 * (i % 2) :]) for _ in range(30)), ("en", "de")[i % 2]) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels, trusted=40).collect()
    # Of 40 rows no language has enough for a limit of its own, of all held-out ones both have.
    assert len(rows) == 400 and len({row["threshold"] for row in rows}) == 2
