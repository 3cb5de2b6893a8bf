import random
import time

import pytest
from pyspark.sql import functions as F

from sagebrook import models, telemetry
from sagebrook.operators import extraction, generation
from sagebrook.plans import agent, routing
from sagebrook.plans.pipeline import Pipeline, StepFailed, StepTimeout


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


ASK = routing.Request(prompt="hello")


def test_fallback():
    clock = Clock()
    s = routing.Fallback(["a", "b"], clock=clock)
    for _ in range(3):
        assert s.select(ASK) == "a"
        s.report("a", False)
    assert s.select(ASK) == "b"
    assert s.after("a", ASK) == "b"
    with pytest.raises(routing.NoProvider):
        s.after("b", ASK)
    clock.now = 61
    assert s.select(ASK) == "a"
    s.report("a", False)
    s.report("a", True)
    assert s.failures["a"] == 0
    with pytest.raises(ValueError):
        routing.Fallback([])


def test_round_robin():
    clock = Clock()
    s = routing.RoundRobin(["a", "b", "c"], clock=clock)
    assert [s.select(ASK) for _ in range(4)] == ["a", "b", "c", "a"]
    for _ in range(3):
        s.report("b", False)
    assert s.available() == ["a", "c"] and s.after("a", ASK) == "c"
    clock.now = 31
    assert s.available() == ["a", "b", "c"]
    w = routing.RoundRobin(["a", "b"], weights={"a": 2, "b": 1})
    assert [w.select(ASK) for _ in range(6)] == ["a", "a", "b", "a", "a", "b"]
    with pytest.raises(ValueError):
        routing.RoundRobin(["a"], weights={"a": 0})


def test_specialist():
    s = routing.Specialist(["gemini", "codex", "claude"])
    pick = lambda **k: s.select(routing.Request(**k))
    assert pick(prompt="Write a function") == "codex"
    assert pick(prompt="Explain this function") == "claude"
    assert pick(prompt="Hi there") == "gemini"
    assert pick(kind="embeddings", prompt="x") == "gemini"
    assert pick(task="code_review") == "codex"
    for _ in range(3):
        s.report("codex", False)
    assert pick(task="code_review") == "gemini"


def test_router():
    class Bad(models.HashProvider):
        def generate(self, prompts):
            raise RuntimeError("down")

    router = routing.Router({"a": Bad("a"), "b": models.HashProvider("b")})
    assert isinstance(router.strategy, routing.Fallback)
    answer, by = router.execute(ASK)
    assert by == "b" and answer.startswith("answer")
    assert isinstance(routing.Router({n: None for n in "abc"}).strategy, routing.Specialist)
    with pytest.raises(routing.NoProvider):
        routing.Router({"a": Bad("a")}).execute(ASK)
    with pytest.raises(ValueError):
        routing.Router({})


def test_router_columns(spark):
    df = spark.createDataFrame([("Analyze and write code",), ("create it",), ("hi",), (None,)], "p string")
    assert [r.t for r in df.select(routing.infer_task(F.col("p")).alias("t")).collect()] == ["analysis", "code_generation", "general", "general"]
    assert df.select(routing.preferred_provider(routing.infer_task(F.col("p"))).alias("t")).first().t == "claude"
    calls = spark.createDataFrame([(1, n, n, f) for n, f in enumerate([True, True, False, True, True, True, True])], "provider long, event_id long, ts long, failed boolean")
    out = routing.failure_streaks(calls).orderBy("event_id").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 2, 3, 4] and [r.tripped for r in out][-2:] == [True, True]


def test_pipeline():
    add = lambda x, c, n=1: x + n
    assert Pipeline("p").add_step(name="a", function=add).add_step(name="b", function=add, args={"n": 5}).execute(1)[0] == 7
    value, context = Pipeline("p").add_step(name="a", function=add, parallel=True).add_step(name="b", function=add, args={"n": 9}, parallel=True).add_step(name="c", function=lambda x, c: x, inputs=["a", "b"]).execute(1)
    assert value == {"a": 2, "b": 10} and context.get_step_result("a") == 2

    def fail(x, c):
        raise RuntimeError("no")

    with pytest.raises(StepFailed):
        Pipeline("p").add_step(name="a", function=fail).execute(1)
    value, context = Pipeline("p").add_step(name="a", function=fail, on_error="continue").add_step(name="b", function=add).execute(1)
    assert value == 2 and context.errors == (("a", "no"),)
    tries = []

    def flaky(x, c):
        tries.append(x)
        if len(tries) < 3:
            raise RuntimeError("no")
        return x

    assert Pipeline("p").add_step(name="a", function=flaky, on_error=("retry", 2)).execute(4)[0] == 4
    with pytest.raises(StepTimeout):
        Pipeline("p").add_step(name="a", function=lambda x, c: time.sleep(2), timeout=0.1).execute(1)
    with pytest.raises(StepTimeout):
        Pipeline("p").add_step(name="a", function=lambda x, c: time.sleep(2)).execute(1, timeout=0.1)


def test_pipeline_cache(spark):
    runs = []

    def count(df, c):
        runs.append(1)
        return df.groupBy().count()

    p = Pipeline("p").add_step(name="n", function=count, cache=True)
    a, b = spark.range(5), spark.range(6)
    assert [p.execute(x)[0].first()[0] for x in (a, a, b)] == [5, 5, 6] and len(runs) == 2
    p.forget()


def test_telemetry():
    seen = []
    telemetry.attach("t", telemetry.events(), lambda event, measured, data: seen.append((event, data.get("step"))))
    Pipeline("p").add_step(name="a", function=lambda x, c: x).execute(1)
    telemetry.detach("t")
    assert seen == [("pipeline.step.start", "a"), ("pipeline.step.stop", "a")] and len(telemetry.events()) == 21


def test_session_and_tools(spark):
    s = agent.Session("s").add_message("user", "hello wörld").add_tool_result("t", {"x": 1}).add_tool_result("t", error="bad").add_message("assistant", "done")
    assert s.message_count() == 4 and [m.role for m in s.last_messages(2)] == ["tool", "assistant"] and s.last_messages(0) == []
    assert s.to_llm_messages()[1] == {"role": "tool", "content": '{"x": 1}', "tool_name": "t"}
    assert s.token_estimate() == sum(len(m.content) for m in s.messages) // 4 and s.clear_messages().message_count() == 0
    assert s.set_context("a", 1).merge_context({"b": 2}).context == {"a": 1, "b": 2}
    log = s.to_table(spark)
    assert log.count() == 4 and agent.transcript(log).first().text == "done"
    assert [r.seq for r in agent.last_messages(log, 2).orderBy("seq").collect()] == [2, 3]
    registry = agent.Registry().register(agent.search_tool(), agent.read_file_tool(), agent.context_tool(), agent.analyze_code_tool())
    assert registry.count() == 4 and registry.execute("search_repos", {"query": "x"}) == [] and registry.execute("get_repo_context", {"repo_name": "r"}) == {"name": "r"}
    assert registry.execute("read_file", {"path": "p", "start_line": 2, "end_line": 3}, {"read_fn": lambda p: "a\nb\nc\nd"}) == "b\nc"
    with pytest.raises(agent.ToolError):
        registry.execute("read_file", {})
    with pytest.raises(agent.ToolError):
        registry.execute("none", {})
    assert registry.filter(lambda t: t.name.startswith("read")).names() == ["read_file"]


def test_code_analysis():
    code = "defmodule Hello do\n  def hello(name) do\n    name\n  end\n\n  defp private_fn, do: :ok\nend\n"
    out = agent.analyze_code(code)
    assert out["modules"] == ["Hello"] and out["functions"] == [{"name": "hello", "arity": 1, "type": "def"}, {"name": "private_fn", "arity": 0, "type": "defp"}] and not out["parse_error"]
    assert agent.analyze_code("def f(a, b): pass", "python")["functions"][0]["arity"] == 2
    assert agent.analyze_code("def f(", "python")["parse_error"] and agent.analyze_code("x", "cobol")["raw_length"] == 1


def test_agent():
    answers = iter(['{"tool": "search_repos", "args": {"query": "x"}}', '{"tool": "missing"}', "the end"])
    a = agent.Agent(lambda prompt: next(answers), agent.Registry().register(agent.search_tool())).with_context({"search_fn": lambda q, o: [q]})
    assert a.process_with_tools("go") == "the end"
    assert [m.error is not None for m in a.history() if m.role == "tool"] == [False, True]
    assert agent.Agent.parse_tool_call("text {") is None and agent.Agent.parse_tool_call('{"tool": "t"}') == ("t", {})
    with pytest.raises(RuntimeError):
        agent.Agent(lambda p: '{"tool": "x"}', max_iterations=2).process_with_tools("go")


def test_models(spark):
    service = models.EmbeddingService(models.HashProvider(dim=4).embed, 10)
    assert len(service.embed_texts([str(n) for n in range(25)])) == 25 and service.stats == {"texts_embedded": 25, "batches_processed": 3, "errors": 0}
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, content string")
    assert [r.embedding is None for r in service.embed_chunks(df).orderBy("id").collect()] == [False, True]

    def broken(texts):
        raise RuntimeError("x")

    assert models.embed(df, broken).orderBy("id").first().error == "RuntimeError: x"
    with pytest.raises(Exception, match="RuntimeError"):
        models.EmbeddingService(broken).embed_chunks(df).collect()
    with pytest.raises(ValueError):
        models.with_vectors(df, df.limit(1))
    send = lambda path, body: (200, {"data": [{"embedding": [1.0]} for _ in body["input"]]}) if "embed" in path else (500, None)
    http = models.HttpProvider("o", send)
    assert http.embed(["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(RuntimeError):
        http.generate(["x"])
    assert list(http.deltas(iter(['data: {"choices": [{"delta": {"content": "hi"}}]}', "", "data: [DONE]"]))) == ["hi"]
    with pytest.raises(ValueError):
        models.ServingProvider().embed(["x"])
    assert models.best_for("writing") == "claude" and models.best_for("other") == "gemini" and models.can_handle("gemini", "embeddings") and not models.can_handle("codex", "embeddings")


def test_generation(spark):
    provider = models.HashProvider(dim=4)
    rows = generation.new(spark.createDataFrame([(1, "q one"), (2, "q two")], "qid long, query string"))
    rows = generation.embed_query(rows, provider.embed)
    results = spark.createDataFrame([(1, 1, "7", "text", 0.5, "s")], "qid long, position int, id string, content string, score double, source string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    rows = generation.put_results(rows, "k", results)
    assert [(r.qid, r.position, r.content) for r in generation.results_of(rows, "k").collect()] == [(1, 1, "text")]
    with pytest.raises(Exception, match="no results"):
        generation.results_of(rows, "nothing").collect()
    rows = generation.build_prompt(generation.build_context_sources(generation.build_context(rows, "k"), "k"))
    done = generation.generate_response(rows, lambda p: ["YES" for _ in p])
    done = generation.detect_hallucination(done, lambda p: ["YES" for _ in p])
    triad = '{"context_relevance_reasoning": "r", "context_relevance_score": 5, "groundedness_reasoning": "r", "groundedness_score": 3, "answer_relevance_reasoning": "r", "answer_relevance_score": 4}'
    done = generation.evaluate_triad(done, lambda p: [triad for _ in p]).cache()
    first = done.where("qid = 1").first()
    assert first.context == "text" and first.context_sources == ["s"] and first.response == "YES" and first.evaluations["hallucination"] == "false"
    assert generation.triad_scores(done).first().groundedness_score == 3

    def down(prompts):
        raise RuntimeError("down")

    failed = generation.evaluate_triad(generation.generate_response(rows, down), down).collect()
    assert all(r.halted and r.errors == ["RuntimeError: down"] and r.response is None for r in failed)


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "Alice works at Acme."), (2, None)], "id long, text string")

    def answer(prompts):
        return ['[{"name": "Alice", "type": "person"}, {"type": "x"}]' if "aliases" in p else '[{"source": "Alice", "target": "Acme"}, {"source": "x"}]' for p in prompts]

    out = extraction.extract(texts, answer).orderBy("id").first()
    assert [(e.name, e.type, e.aliases) for e in out.entities] == [("Alice", "person", [])]
    assert [(r.source, r.type, r.weight) for r in out.relationships] == [("Alice", "related_to", 1.0)] and out.error is None
    assert extraction.extract(texts, lambda p: ["nothing"] * len(p)).orderBy("id").first().error == "invalid_entity_format"


def test_streaks_over_many_parts(spark):
    rng = random.Random(4)
    rows = [(p, n, n // 3, rng.random() < 0.9) for p in (1, 2) for n in range(400)]
    calls = spark.createDataFrame(rows, "provider long, event_id long, ts long, failed boolean")
    want, now = {}, {}
    for p, n, _, f in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now[p] = now.get(p, 0) + 1 if f else 0
        want[p, n] = now[p]
    out = routing.failure_streaks(calls).collect()
    assert {(r.provider, r.event_id): r.streak for r in out} == want
