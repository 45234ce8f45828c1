"""Landed answers, the store, whole runs and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from answerlens.operators import facts as fx
from answerlens.operators import metrics
from answerlens.operators.facts import Facts
from answerlens.plans.pipeline import parse_landing, run_pipeline
from answerlens.schemas import LANDING
from answerlens.sources import answers as landed
from answerlens.sources.store import FactStore, create_tables, publish
from answerlens.streaming.ingest import ingest

ROWS = [
    (1, "gemini", "Bonsai is great. HubSpot is slow.", [("https://g2.com/a", None)], True, None),
    (2, "gemini", "Try HubSpot, see https://x.org and [y](https://y.org/p).", [], True, None),
    (3, "gemini", "", [], True, "429 quota PerDay"),
    (4, "gemini", None, None, None, None),
    (5, "gemini", "Bonsai", [("https://b.org", None)], False, None),
]


@pytest.fixture
def landing(spark):
    return spark.createDataFrame(ROWS, LANDING)


@pytest.fixture
def brands(spark):
    return spark.createDataFrame([(0, "HubSpot"), (1, "Bonsai")], "ord int, brand_name string")


def state(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_run_and_repeat(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    assert store.responses.count() == store.mentions.count() == store.citations.count() == 0
    stats = run_pipeline(landing, brands, store, "one").first().asDict()
    expected = {
        "total_prompts": 5, "processed": 3, "skipped": 0, "api_errors": 2, "total_mentions": 4,
        "total_citations": 4, "grounded_citations": 1, "fallback_citations": 3,
    }
    assert stats == expected
    assert state(store.responses, "prompt_id", "platform") == [(1, "gemini"), (2, "gemini"), (5, "gemini")]
    joined = store.mentions.join(store.responses.withColumnRenamed("id", "response_id"), "response_id")
    assert state(joined, "prompt_id", "brand_name", "position", "sentiment") == [
        (1, "Bonsai", 1, "recommended"), (1, "HubSpot", 2, "negative"), (2, "HubSpot", 1, "neutral"), (5, "Bonsai", 1, "neutral"),
    ]
    assert store.citations.columns == ["id", "response_id", "source_url", "source_domain"]

    # Repeating a run replaces it.
    assert run_pipeline(landing, brands, store, "one").first().asDict() == expected
    assert store.responses.count() == 3 and store.mentions.count() == 4 and store.citations.count() == 4

    # Another run adds to it, with ids of its own, unless told to skip.
    run_pipeline(landing, brands, store, "two")
    assert store.responses.count() == 6 == store.responses.select("id").distinct().count()
    assert store.mentions.select("id").distinct().count() == 8
    assert fx.orphans(store.mentions, store.responses).count() == 0
    skipped = run_pipeline(landing, brands, store, "three", skip_existing=True).first()
    assert (skipped.processed, skipped.skipped, skipped.api_errors) == (0, 3, 2)
    assert store.responses.count() == 6

    # A forced run leaves only itself, and does not give out old ids again.
    highest = max(r.id for r in store.responses.collect())
    run_pipeline(landing, brands, store, "four", force=True)
    assert store.responses.count() == 3 and min(r.id for r in store.responses.collect()) > highest
    store.clear()
    assert store.responses.count() == store.mentions.count() == store.citations.count() == 0


def test_long_and_short_brand_lists_store_the_same(spark, landing, brands, monkeypatch):
    short = state(parse_landing(landing, brands), "prompt_id", "mention_items", "citation_items", "from_grounding")
    monkeypatch.setattr("answerlens.plans.pipeline.LITERAL_BRANDS", 1)
    long = state(parse_landing(landing, brands), "prompt_id", "mention_items", "citation_items", "from_grounding")
    assert short == long and len(short) == 3


def test_a_broken_run_is_invisible(spark, landing, brands, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing, brands, store, "one")
    before = [state(store.table(t), *store.table(t).columns) for t in ("responses", "mentions", "citations")]
    write = FactStore._write

    def breaks(self, table, *args, **counts):
        if table == broken:
            raise RuntimeError("lost")
        return write(self, table, *args, **counts)

    monkeypatch.setattr(FactStore, "_write", breaks)
    for broken in ("mentions", "citations"):
        for run_id, force in (("one", False), ("two", False), ("two", True)):
            with pytest.raises(RuntimeError, match="lost"):
                run_pipeline(landing, brands, store, run_id, force=force)
            assert before == [state(store.table(t), *store.table(t).columns) for t in ("responses", "mentions", "citations")]
    monkeypatch.undo()
    # Repeated, it counts once.
    run_pipeline(landing, brands, store, "two")
    assert store.responses.count() == 6 and store.mentions.count() == 8
    assert store.responses.select("id").distinct().count() == 6 and fx.orphans(store.citations, store.responses).count() == 0


def test_ids_are_given_without_reading_facts(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing, brands, store, "one")
    highest = {t: max(r.id for r in store.table(t).collect()) for t in ("responses", "mentions", "citations")}
    assert store.next_ids() == ({t: n + 1 for t, n in highest.items()}, 2)
    files = store.runs.inputFiles()
    assert files and all("/runs/" in f for f in files)
    run_pipeline(landing, brands, store, "two")
    assert all(min(r.id for r in store.before_run(t, "one").collect()) > highest[t] for t in highest)


def test_landing_is_read_once(spark, brands, tmp_path):
    """Counts are exact although no row is read for them alone."""
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            reads.add(batch.num_rows)
            yield batch

    store = FactStore(spark, str(tmp_path / "facts"))
    rows = spark.createDataFrame(ROWS, LANDING).mapInArrow(seen, LANDING)
    run_pipeline(spark.createDataFrame(ROWS[:1], LANDING), brands, store, "one")
    stats = run_pipeline(rows, brands, store, "two", skip_existing=True).first()
    assert (stats.total_prompts, stats.processed, stats.skipped, stats.api_errors) == (5, 2, 1, 2)
    assert reads.value == 5


def test_deletes_rewrite_only_the_runs_they_touch(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing.filter("prompt_id < 3"), brands, store, "one")
    run_pipeline(landing.filter("prompt_id >= 3"), brands, store, "two")
    run_pipeline(landing.filter("prompt_id = 1"), brands, store, "three")
    attempts = {r.run_id: r.attempt for r in store.standing().collect()}
    keys = spark.createDataFrame([(1, "gemini"), (1, "gemini"), (9, "other"), (None, "gemini")], "prompt_id long, platform string")
    want = fx.delete_responses(store.responses, store.mentions, store.citations, keys)
    want = [state(getattr(want, t), *getattr(want, t).columns) for t in ("responses", "mentions", "citations")]
    assert store.delete_responses(keys) == ["one", "three"]
    assert want == [state(store.table(t), *store.table(t).columns) for t in ("responses", "mentions", "citations")]
    now = {r.run_id: r.attempt for r in store.standing().collect()}
    assert now["two"] == attempts["two"] and now["one"] != attempts["one"] and now["three"] != attempts["three"]
    assert store.delete_responses(keys) == []
    # A run can be replaced after that, and the others stay.
    run_pipeline(landing.filter("prompt_id = 5"), brands, store, "one")
    assert state(store.responses, "prompt_id") == [(5,), (5,)]


def test_null_url_is_stored(spark, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    rows = spark.createDataFrame([(1, "g", "Bonsai", [(None, "G2 Reviews: Bonsai")], True, None)], LANDING)
    run_pipeline(rows, brands, store, "one")
    assert state(store.citations, "source_url", "source_domain") == [(None, "g2 reviews: bonsai")]


def test_cascade_delete_to_a_snapshot(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing, brands, store, "one")
    keys = spark.createDataFrame([(1, "gemini"), (2, "other")], "prompt_id long, platform string")
    target = FactStore(spark, str(tmp_path / "snapshot"))
    target.write_snapshot(fx.delete_responses(store.responses, store.mentions, store.citations, keys))
    assert state(target.responses, "prompt_id") == [(2,), (5,)]
    assert state(target.mentions, "brand_name") == [("Bonsai",), ("HubSpot",)]
    assert target.citations.count() == 3


def test_latest_response(spark):
    rows = spark.createDataFrame(
        [(1, 7, "a", "x"), (2, 7, "a", "y"), (3, 7, "b", "z"), (4, 8, "a", "w")],
        "id long, prompt_id long, platform string, raw_text string",
    )
    assert state(fx.latest_responses(rows), "id", "raw_text") == [(2, "y"), (3, "z"), (4, "w")]


def test_answer_documents(spark):
    full = {
        "candidates": [
            {
                "content": {"parts": [{"text": "A"}, {"text": ""}, {"other": 1}, {"text": "B"}]},
                "grounding_metadata": {
                    "grounding_chunks": [
                        {"web": {"uri": "https://a.org", "title": "a"}}, {"web": {"title": "t"}}, {"web": {}}, {},
                        {"web": {"uri": "", "title": None}},
                    ]
                },
            },
            {"content": {"parts": [{"text": "C"}]}, "grounding_metadata": {"grounding_chunks": [{"web": {"uri": "https://no.org"}}]}},
        ]
    }
    texts = [json.dumps(full), "{}", '{"candidates": []}', '{"candidates": [{"content": null}]}', "no json"]
    documents = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    found = landed.parse_documents(documents).orderBy("id").collect()
    assert [r.raw_text for r in found] == ["ABC", "", "", "", ""]
    assert [tuple(c) for c in found[0].citations] == [("https://a.org", "a"), (None, "t")]
    assert all(r.citations == [] for r in found[1:]) and all(r.grounded for r in found)
    assert landed.parse_documents(documents, grounding=False).orderBy("id").first().citations == []


def test_quota_flag(spark):
    errors = ["429 x PerDay y", "429 x PerMinute", "500 daily", "RESOURCE_EXHAUSTED per_day", "429 DAILY", None]
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "i int, error string")
    flags = frame.select("i", landed.daily_quota_exhausted(frame.error).alias("f")).orderBy("i").collect()
    assert [r.f for r in flags] == [True, False, False, True, False, False]


def test_bucketed_tables_join_without_shuffle(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing, brands, store, "one")
    create_tables(spark, "visibility", 4)
    create_tables(spark, "visibility", 4)
    publish(store.facts(), "visibility")
    tables = Facts(*[spark.table(f"visibility.{t}") for t in ("responses", "mentions", "citations")])
    prompts = spark.createDataFrame([(1, "a", "research")], "id long, text string, stage string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The dimension is small, so that only the facts are left to be shuffled.
        stages = prompts.hint("broadcast")
        facts = fx.filtered_facts(tables.responses, tables.mentions, tables.citations, stages)
        plan = facts.mentions._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        assert facts.mentions.count() == 4
        assert metrics.average_position(facts).count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_run_without_mentions_or_answers(spark, landing, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    run_pipeline(landing, brands, store, "kept")
    run_pipeline(landing, brands, store, "one")
    nobody = spark.createDataFrame([(0, "Nobody")], "ord int, brand_name string")
    stats = run_pipeline(landing, nobody, store, "one").first()
    assert (stats.processed, stats.total_mentions) == (3, 0)
    assert (store.responses.count(), store.mentions.count(), store.citations.count()) == (6, 4, 8)
    assert fx.orphans(store.mentions, store.responses).count() == 0
    failed = landing.withColumn("error", F.lit("quota"))
    stats = run_pipeline(failed, brands, store, "one").first()
    assert (stats.processed, stats.api_errors, stats.total_citations) == (0, 5, 0)
    assert (store.responses.count(), store.mentions.count(), store.citations.count()) == (3, 4, 4)
    with pytest.raises(ValueError, match="run id"):
        run_pipeline(landing, brands, store, "../one")


def test_two_streams_into_one_store(spark, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    for n, name in enumerate(("a", "b"), 1):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.json").write_text(json.dumps({"prompt_id": n, "platform": "gemini", "raw_text": "HubSpot"}))
        ingest(store, brands, str(folder), str(tmp_path / f"progress-{name}"), stream=name).awaitTermination()
    assert state(store.responses, "prompt_id") == [(1,), (2,)]


def test_stream(spark, brands, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    folder = tmp_path / "landing"
    folder.mkdir()

    def land(name, prompt, text):
        row = {"prompt_id": prompt, "platform": "gemini", "raw_text": text, "citations": [], "grounded": True}
        (folder / name).write_text(json.dumps(row))

    def run():
        ingest(store, brands, str(folder), str(tmp_path / "progress"), stream="answers").awaitTermination()

    land("a.json", 1, "HubSpot is best.")
    run()
    assert state(store.mentions, "brand_name", "sentiment") == [("HubSpot", "recommended")]
    land("b.json", 2, "Bonsai and HubSpot")
    run()
    run()
    assert state(store.responses, "prompt_id") == [(1,), (2,)]
    assert store.mentions.count() == 3 == store.mentions.select("id").distinct().count()
