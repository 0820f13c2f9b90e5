"""The word model and its cuts against all cuts of short runs."""

import itertools
import math

import numpy as np
import pytest

from quarry.operators import segmentation as S


def all_cuts(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        words = [run[a:z] for a, z in itertools.pairwise(ends)]
        if all(len(w) <= S.LONGEST for w in words):
            yield words


def score(words, p):
    return sum(p.get(w, -math.inf) for w in words)


RUNS = ["北京大学生", "大学生活", "北京", "生活", "大学", "北京大学", "学生大学", "京", "活活活活活活"] * 3 + ["北京生活大学生活"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"{r}，abc {r[::-1]}。") for i, r in enumerate(RUNS)] + [(100, None), (101, ""), (102, "no such run")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_one_round_is_expectation_over_all_cuts(spark, texts):
    start = S.fit_words(texts, least=2, rounds=0)
    p = {w: x for w, _, x in start.rows()}
    want = dict.fromkeys(p, 0.0)
    for run in [r for x in RUNS for r in (x, x[::-1])]:
        cuts = [(c, math.exp(score(c, p))) for c in all_cuts(run) if score(c, p) > -math.inf]
        total = sum(w for _, w in cuts)
        for c, w in cuts:
            for piece in c:
                want[piece] += w / total
    got = {w: n / S.UNIT for w, n, _ in S.fit_words(texts, least=2, rounds=1).rows()}
    for w, x in want.items():
        if len(w) == 1 or x >= 1.001:
            assert got[w] == pytest.approx(max(x, 1 / S.UNIT), abs=1e-3)
        elif x < 0.999:
            assert w not in got


def test_candidates_are_counts(spark, texts):
    pieces = {}
    for run in [r for x in RUNS for r in (x, x[::-1])]:
        for a, z in itertools.combinations(range(len(run) + 1), 2):
            if z - a <= S.LONGEST:
                pieces[run[a:z]] = pieces.get(run[a:z], 0) + 1
    model = S.fit_words(texts, least=6, rounds=0)
    assert {w: n // S.UNIT for w, n, _ in model.rows()} == {w: n for w, n in pieces.items() if n >= 6 or len(w) == 1}
    assert (np.diff(model.keys.astype(object)) > 0).all()
    small = S.fit_words(texts, least=2, most=3, rounds=0)
    assert sum(len(w) > 1 for w, _, _ in small.rows()) == 3


def test_best_cuts(spark, texts):
    model = S.fit_words(texts, least=2, rounds=3)
    p = {w: x for w, _, x in model.rows()}
    cut = S.cut_words(texts.withColumn("extra", S.F.array("doc_id")), model)
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[100].words == rows[101].words == rows[102].words == []
    for i, run in enumerate(RUNS):
        words = rows[i].words
        assert rows[i].extra == [i] and "".join(words) == run + run[::-1]
        for part in (run, run[::-1]):
            taken = []
            while "".join(taken) != part:
                taken.append(words.pop(0))
            assert score(taken, p) == pytest.approx(max(score(c, p) for c in all_cuts(part)), abs=1e-9)


def test_fit_is_the_same_on_any_partitions(spark, texts):
    a, b = S.fit_words(texts.repartition(7), least=2), S.fit_words(texts.coalesce(1), least=2)
    assert a.rows() == b.rows()


def test_edges(spark, texts):
    none = S.fit_words(texts.limit(0))
    assert none.rows() == []
    df = spark.createDataFrame([("北京",), (None,)], "text string")
    assert [r.words for r in S.cut_words(df, none).collect()] == [["北", "京"], []]
    assert S.cut_words(df.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        S.cut_words(df, none, out="text")
    model = S.fit_words(texts, least=2)
    long = spark.createDataFrame([("北京大学" * 50_000 + "龘",)], "text string")
    words = S.cut_words(long, model).first().words
    assert "".join(words) == "北京大学" * 50_000 + "龘" and words[-1] == "龘"


def test_question_terms(spark, texts):
    model = S.Words(*map(np.array, zip(*sorted((int.from_bytes(w.encode("utf-16-be")), 1, math.log(0.2)) for w in ("北京", "大学", "生", "活")), strict=True)))
    model = S.Words(model.keys.astype(np.uint64), model.expected, model.log_p)
    q = spark.createDataFrame([("请问北京的大学abc-1怎么生活",), (None,)], "text string")
    got = [r.terms for r in S.question_terms(q, model, most=100).collect()]
    assert got[1] == []
    text = "abc-1"
    parts = {text[a:z] for a in range(5) for z in range(a + 2, min(a + 4, 5) + 1)}
    want = parts | {"abc-1", "北京", "大学", "生", "活", "北京大学", "大学生", "生活", "北京大学生", "大学生活"}
    assert set(got[0]) == want and [len(x) for x in got[0]] == sorted((len(x) for x in want), reverse=True)
