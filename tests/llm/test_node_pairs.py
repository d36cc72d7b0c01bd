"""Pairs inside a node: those that go on have passed the whole sieve, not its first half only."""

import random

from pyspark.sql import functions as F

from emberline.llm import chosen_path as cp


def test_texts_with_one_passage_in_common_do_not_meet(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(50)]
    texts = [" ".join(passage + [word() for _ in range(32)]) for _ in range(150)]  # about 0.4 alike
    near = [word() for _ in range(90)]
    texts += [" ".join(near), " ".join(near[:-4]), " ".join(near[2:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = cp.features(docs).select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), "tok", "sig").cache()
    at = rows.select(F.lit(1).cast("long").alias("key"), "v", "n", F.col("v").alias("label"), F.lit(True).alias("unlike"))
    met = {tuple(p) for p in cp._across(at, rows).collect()}
    a, b = (rows.select(*[F.col(c).alias(f"{c}{k}") for c in ("v", "n", "sig")]) for k in "ab")
    pairs = a.join(b, (F.col("va") > F.col("vb")) & cp._near_sizes("na", "nb"))
    first = pairs.filter(cp._agree("siga", "sigb", cp.FIRST_LONGS, cp.FIRST_AGREEING))
    whole = first.filter(cp._agree("siga", "sigb", cp.LONGS, cp.AGREEING))
    assert met == {(p.va, p.vb) for p in whole.collect()} >= {(151, 150), (152, 150)}
    assert first.count() > 10 * len(met)
