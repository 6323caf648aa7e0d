"""The corpus pipeline against a brute-force version on a small corpus."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def corpus():
    """Clean prose, toxic prose, exact and near copies, and documents that hold a benchmark passage."""
    r = np.random.default_rng(8)
    word = lambda: f"w{r.integers(0, 400)}"
    items = [" ".join(f"q{r.integers(0, 60)}" for _ in range(14)) for _ in range(3)]
    texts, toxic = [], set()
    for i in range(240):
        words = [word() for _ in range(80)]
        if i % 6 == 1:
            words[5:11] = r.choice(["vile", "foul", "scum"], 6)
            toxic.add(i)
        if i % 20 == 2:
            words[20:34] = items[i % 3].split()
        texts.append(" ".join(words))
    for i in range(0, 60, 4):
        texts.append(texts[i].replace(" ", "\n ", 3))  # exact but for white space
    for i in range(0, 60, 5):
        if i not in toxic:
            words = texts[i].split()
            words[40] = "changed"
            texts.append(" ".join(words))
    toxic |= {n for n, t in enumerate(texts) if "vile" in t or "foul" in t or "scum" in t}
    return [*texts, "", None], toxic, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, toxic, items = corpus()
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(len(texts) - 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def expected():
    texts, toxic, items = corpus()
    left = {i: t or "" for i, t in enumerate(texts) if i not in toxic}
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    left = {i: left[i] for g in groups.values() for i in [min(g, key=lambda x: (-len(left[x]), x))]}
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in left.items()}
    part = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = part[i], part[j]
                part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    left = {i: t for i, t in left.items() if part[i] == i}
    windows = {tuple(w[a : a + 10]) for item in items for w in [item.split()] for a in range(5)}
    return {i: t for i, t in left.items() if not any(tuple(w[a : a + 10]) in windows for w in [t.split()] for a in range(len(w) - 9))}


def test_pipeline_against_brute_force(spark, folder):
    want = expected()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)
    assert all(got[i].size == len(t.split()) for i, t in want.items())
    per = {}
    for r in got.values():
        s = per.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] += r.size
    assert all(abs(taken - target) <= 1 and target <= 3 * size for taken, target, size in per.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_id", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), folder).count() == 0


# Rows of one doc_id, or none, with different texts


def texts_left(stage, spark, rows, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in stage(spark, docs, folder).collect()), key=str)


@pytest.mark.parametrize("i", [None, 900])
def test_stages_drop_the_rows_judged_not_their_ids(spark, folder, i):
    n = -1 if i is None else i
    r = np.random.default_rng(3)
    clean = [" ".join(f"w{x}" for x in r.integers(0, 400, 80)) for _ in range(3)]
    foul = clean[0].replace(" ", " vile foul scum ", 4)
    held = f"{clean[1]} {corpus()[2][0]}"
    near = clean[2].rsplit(" ", 1)[0] + " changed"
    known = [(x, t) for x, t in enumerate(corpus()[0])]  # toxicity is learnt from these
    left = texts_left(corpus_pipeline.drop_toxic, spark, [*known, (i, foul), (i, clean[1])], folder)
    assert (n, clean[1]) in left and (n, foul) not in left
    assert texts_left(corpus_pipeline.drop_contaminated, spark, [(i, held), (i, clean[0])], folder) == [(n, clean[0])]
    assert texts_left(corpus_pipeline.drop_exact, spark, [(i, "x"), (i, "x"), (i, " x"), (i, "y"), (1, "z z"), (i, "zz")], folder) == sorted([(n, " x"), (n, "y"), (1, "z z")], key=str)
    assert texts_left(corpus_pipeline.drop_near, spark, [(1, clean[2]), (i, near), (i, clean[0]), (i, ""), (i, None)], folder) == sorted([(1, clean[2]), (n, clean[0]), (n, ""), (n, None)], key=str)
    assert len(texts_left(corpus_pipeline.drop_near, spark, [(i, clean[2]), (i, near), (i, clean[0])], folder)) == 2
