"""Question files, splits, compared runs and plans on small fixtures."""

import math

from quarry.operators import runs as R


def test_question_files_keep_what_is_whole(spark, tmp_path):
    good = '{"meta": 1, "questions": [{"id": 1, "question": "q1", "category": ""}, {"id": "2"}, {"question": "no id"}, {"id": "3", "question": "q3", "relevant_chunk_ids": ["c"], "category": "x"}]}'
    for name, text in (("a.json", good), ("b.json", '{"questions": {"a": 1}}'), ("c.json", "no json"), ("d.json", "{}")):
        (tmp_path / name).write_text(text)
    got = {r.id: r for r in R.generated_questions(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "3"}
    assert got["1"].category == "generated" and got["1"].relevant_chunk_ids == [] and got["1"].ground_truth_answer == ""
    assert got["3"].category == "x" and got["3"].relevant_chunk_ids == ["c"]


def test_gold_file_goes_before_own_chunks(spark, tmp_path):
    (tmp_path / "gold.json").write_text('{"questions": {"1": {"chunk_ids": ["g"], "parent_ids": null}, "9": {}}}')
    (tmp_path / "bad.json").write_text('{"questions": [1]}')
    gold = R.gold_answers(spark, str(tmp_path))
    assert sorted((r.id, r.chunk_ids, r.parent_ids) for r in gold.collect()) == [("1", ["g"], []), ("9", [], [])]
    q = spark.createDataFrame([("1", ["own"]), ("2", ["own"])], "id string, relevant_chunk_ids array<string>")
    assert {r.id: r.relevant_chunk_ids for r in R.with_gold(q, gold).collect()} == {"1": ["g"], "2": ["own"]}


def test_subsets(spark):
    q = spark.createDataFrame([("emp1", True), ("lex1", None), ("emp2", False)], "id string, answerable boolean")
    ids = lambda name: sorted(r.id for r in R.subset(q, name).collect())
    assert ids("all") == ["emp1", "emp2", "lex1"] and ids("emp") == ["emp1", "emp2"] and ids("unans") == ["emp2"]


def test_splits_by_document(spark):
    chunks = spark.createDataFrame([("a", "8"), ("b", "7"), ("c", "d"), ("n", None)], "chunk string, doc string")
    rows = [(1, ["a", "b"], None), (2, ["b"], "other"), (3, ["a"], "dev"), (4, [], "test"), (5, None, None), (6, ["c"], None), (7, ["n", "x"], None)]
    got = {r.question: r.split for r in R.question_splits(spark.createDataFrame(rows, "question int, gold array<string>, hint string"), chunks).collect()}
    assert got == {1: "test", 2: "dev", 3: "dev", 4: "test", 5: "dev", 6: "test" if ord("d") % 4 == 0 else "dev", 7: "dev"}


def test_pairs_and_exact_test(spark):
    a = spark.createDataFrame([("m", i, 1.0 if i < 5 else 0.0) for i in range(8)] + [("m", 0, None), ("m", 50, 1.0), ("m", 7, -1.0), ("only_a", 1, 1.0)], "metric string, question_id int, value double")
    b = spark.createDataFrame([("m", i, 1.0 if i in (0, 7) else 0.0) for i in range(8)] + [("m", 60, 1.0), ("m", 1, None)], "metric string, question_id int, value double")
    r = R.pair_report(R.paired_values(a, b)).collect()
    assert len(r) == 1 and (r[0].n, r[0].only_a, r[0].only_b) == (8, 4, 1)
    assert math.isclose(r[0].p, 2 * (1 + 5) / 32) and math.isclose(r[0].delta, 2 / 8 - 5 / 8)
    assert R.pair_report(R.paired_values(a.limit(0), b)).count() == 0


def test_latencies_leave_out_what_did_not_run(spark):
    rows = [("total", "completed", float(x)) for x in (10, 20, 30, 40)] + [("total", "failed", 9e9), ("total", "completed", 0.0), ("generation", "completed", None), ("generation", "completed", 0.0)]
    got = R.stage_latencies(spark.createDataFrame(rows, "stage string, status string, ms double")).collect()
    assert [(r.stage, r.p50, round(r.p95, 6), r.samples) for r in got] == [("total", 25.0, 38.5, 4)]


def test_steps_anew(spark):
    asked = spark.createDataFrame([(1, 9, [2, 7, 2, 1], [3, 2]), (2, 9, None, []), (3, 9, None, [2])], "plan int, doc int, parents array<int>, children array<int>")
    had = spark.createDataFrame([(1, 9, 1, "PARENT", 1, "old"), (1, 9, 2, "parent", 1, "new"), (1, 8, 1, "CHILD", 3, "other"), (3, 9, 1, "Child", 2, None)], "plan int, doc int, step_no int, pipeline string, strategy int, reason string")
    got = [tuple(r) for r in R.normalised_steps(asked, had).orderBy("plan", "step_no").collect()]
    add = R.ADDED_REASON
    assert got == [
        (1, 9, 1, "parent", 2, R.PRIMARY, R.USER_ADD, add), (1, 9, 2, "parent", 2, R.FALLBACK, R.USER_ADD, add), (1, 9, 3, "parent", 1, R.OPTIMIZE, R.USER_KEEP, "new"),
        (1, 9, 4, "child", 3, R.PRIMARY, R.USER_ADD, add), (1, 9, 5, "child", 2, R.FALLBACK, R.USER_ADD, add), (3, 9, 1, "child", 2, R.PRIMARY, R.USER_KEEP, None),
    ]


def test_confirmations(spark):
    plans = spark.createDataFrame([(1, 9, 1), (2, 9, 1), (3, 9, 1), (4, 8, 0)], "plan int, doc int, status int")
    given = spark.createDataFrame([(1, 9, 70, 5), (1, 9, 71, 6), (2, 9, 72, 6), (4, 9, 73, 7)], "plan int, doc int, user int, at int")
    got = [tuple(r) for r in R.confirmed_plans(plans, given).orderBy("plan").collect()]
    assert got == [(1, 9, 2, 71, 6, False), (2, 9, 2, 72, 6, True), (3, 9, 1, None, None, False), (4, 8, 0, None, None, False)]
    assert [r.plan for r in R.unknown_confirmations(plans, given).collect()] == [4]
