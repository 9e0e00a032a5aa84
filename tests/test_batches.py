"""Batches in one global order, and the judge that is called in them."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.embedder import FailingEmbedder, HashingEmbedder
from lectern.functions.standins import LexicalJudge, quote_prompts
from lectern.operators import batches as B
from lectern.operators import judge as J
from lectern.operators.context import generate_answers
from lectern.plans import evaluate as EV
from lectern.plans import serve as SV


def _rows(spark, n, parts):
    df = spark.createDataFrame([(f"{i * 7919 % n:05d}", "secret" if i % 400 == 3 else "text") for i in range(n)], "question_id string, question string")
    return df.repartition(parts) if parts > 1 else df.coalesce(1)


@pytest.mark.parametrize("parts", [1, 8])
def test_places_are_global_and_slices_exact(spark, parts):
    got = B.sliced(_rows(spark, 1234, parts), [F.col("question_id")], 50).collect()
    assert sorted(r._place for r in got) == list(range(1234))
    assert all(int(r.question_id) == r._place and r._slice == r._place // 50 for r in got)
    assert B.numbered(_rows(spark, 10, 1).limit(0), [F.col("question_id")]).collect() == []


def test_question_batches_do_not_depend_on_partitions(spark):
    emb = FailingEmbedder(HashingEmbedder(4), "secret")
    failed = []
    for parts in (1, 8):
        rows = _rows(spark, 1234, parts)
        failed.append(sorted(r.question_id for r in SV.embed_questions(rows, emb).filter("error is not null").collect()))
    bad = {int(r.question_id) // 50 for r in _rows(spark, 1234, 1).filter("question = 'secret'").collect()}
    assert failed[0] == failed[1] == [f"{i:05d}" for i in range(1234) if i // 50 in bad]


def test_calls_get_full_batches_and_keep_failed_rows(spark):
    def generate(prompts):
        if any("secret" in p for p in prompts):
            raise RuntimeError("refused")
        return [f"{len(prompts)} at once" for _ in prompts]

    rows = _rows(spark, 205, 5).withColumnRenamed("question", "prompt")
    out = {r.question_id: r for r in generate_answers(rows, generate, order_by=[F.col("question_id")]).collect()}
    assert len(out) == 205
    bad = {int(k) // 8 for k, r in out.items() if r.prompt == "secret"}
    for k, r in out.items():
        n = int(k) // 8
        assert (r.answer is None) == (n in bad) == (r.answer_error == "RuntimeError: refused")
        assert n in bad or r.answer == ("5 at once" if n == 25 else "8 at once")


def _dataset(spark):
    rows = [(1, "where is the fish", "The fish swims. Birds sing. ", ["a fish swims here", "the sea"], "Here the fish swims."),
            (2, "birds", None, [], None), (3, "trees", "", ["some trees"], "")]
    return spark.createDataFrame(rows, "question_id int, question string, answer string, contexts array<string>, ground_truth string")


def test_judge_gives_typed_verdicts(spark):
    judged = J.judge_rows(_dataset(spark), LexicalJudge())
    by = {r.question_id: r for r in judged.collect()}
    assert [tuple(c) for c in by[1].claims] == [("The fish swims", True), (" Birds sing", False)]
    assert by[1].relevant == [True, False] and [tuple(g) for g in by[1].generated] == [("The fish swims", False), (" Birds sing", False)]
    assert by[2].claims == [] == by[2].relevant and by[3].relevant == [True] and all(r.judge_error is None for r in by.values())
    tables = {k: sorted(map(tuple, v.collect())) for k, v in J.verdicts(judged).items()}
    assert tables["supported"] == [(1, 1, 1), (1, 2, 0)] and tables["attributed"] == [(1, 1, 1)]
    assert tables["relevant"] == [(1, 1, 1), (1, 2, 0), (3, 1, 1)]
    assert tables["generated"] == [(1, 1, "The fish swims", False), (1, 2, " Birds sing", False)]


@pytest.mark.parametrize("wrong", [lambda rows: [], lambda rows: [{"claims": []}] * len(rows), lambda rows: 1 / 0,
                                   lambda rows: [dict(claims=[], truths=[], relevant=[True] * 9, generated=[])] * len(rows)])
def test_a_failed_verdict_fails_its_batch_only(spark, wrong):
    plain = LexicalJudge()

    def judge(rows):
        return wrong(rows) if any(r["question"] == "birds" for r in rows) else plain(rows)

    by = {r.question_id: r for r in J.judge_rows(_dataset(spark), judge, batch_size=1).collect()}
    assert by[2].judge_error and by[2].claims is None and by[2].relevant is None
    assert by[1].judge_error is None and by[3].judge_error is None and len(by[1].claims) == 2


def _world(spark):
    emb = HashingEmbedder(32)
    texts = ["red fish swim. they swim", "blue birds sing", "green trees grow", "white horses run"]
    idx = spark.createDataFrame([(f"c{i}", t, v) for i, (t, v) in enumerate(zip(texts, emb(texts).tolist()))],
                                "chunk_id string, text string, vector array<float>")
    qs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id int, question string")
    truths = qs.select("question_id", F.col("question").alias("ground_truth"))
    return emb, idx, qs, truths


def test_four_metrics_and_the_gate(spark):
    emb, idx, qs, truths = _world(spark)
    ds, per_q, gate, passed = EV.evaluate(qs, idx, emb, 2, generate=lambda ps: ["red fish swim"] * len(ps), ground_truths=truths,
                                          judge_model=LexicalJudge(), thresholds={"context_recall": 0.9})
    rows = {r.question_id: r for r in per_q.collect()}
    assert rows[0].faithfulness == 1.0 and rows[0].context_recall == 1.0 and rows[0].context_precision == 1.0
    assert rows[0].answer_relevancy > rows[1].answer_relevancy
    assert all(r.answer and r.ground_truth for r in ds.collect())
    seen = {r.metric: (r.mean, r.passed) for r in gate.collect()}
    assert passed and seen["failed_verdicts"] == (0.0, True) and seen["context_recall"] == (1.0, True) and len(seen) == 8


@pytest.mark.parametrize("broken", ["generate", "judge", "vectors"])
def test_any_failed_call_fails_the_gate(spark, broken):
    emb, idx, qs, truths = _world(spark)
    generate, judge = quote_prompts, LexicalJudge()
    if broken == "generate":
        generate = lambda ps: 1 / 0
    elif broken == "judge":
        judge = lambda rows: 1 / 0
    else:
        emb = FailingEmbedder(emb, "refused")
        generate = lambda ps: ["refused words here"] * len(ps)
    _, _, gate, passed = EV.evaluate(qs, idx, emb, 2, generate=generate, ground_truths=truths, judge_model=judge, thresholds={})
    rows = {r.metric: (r.mean, r.passed) for r in gate.collect()}
    name = {"generate": "failed_answers", "judge": "failed_verdicts", "vectors": "failed_vectors"}[broken]
    assert not passed and rows[name] == (4.0, False)
