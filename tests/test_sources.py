import json

import numpy as np
import pytest

from textloom.operators.ordered import with_position
from textloom.sources import records, sinks
from textloom.streaming import near_index


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_positions(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("(id * 37) % 1000 AS x", "CAST(id % 3 AS long) AS n")
    got = sorted((r.x, r.position, r.before) for r in with_position(df, "x", total="n").collect())
    at = {r.x: r.n for r in df.collect()}
    assert [g[:2] for g in got] == [(i, i) for i in range(1000)] and [g[2] for g in got] == [sum(at[k] for k in range(i)) for i in range(1000)]
    assert with_position(df.where("x < 0"), "x").count() == 0


def test_pool_and_items(spark, tmp_path):
    p = lines(tmp_path / "pool.jsonl", [{"prompt_id": "0000000001", "category": "IF"}, "", {"prompt_id": "0000000000", "category": "STR"}])
    assert [r.category for r in records.pool(spark, p).collect()] == ["STR", "IF"] and records.pool(spark, p, 1).count() == 1
    b = lines(tmp_path / "b.jsonl", [{"item_id": "a", "text": "t"}, {"item_id": "b", "question": "q", "options": ["x", "y"], "answer": ""}])
    assert [(r.benchmark, r.split, r.text) for r in records.benchmark_items(spark, b).collect()] == [("unknown", "test", "t"), ("unknown", "test", "q x y")]


def test_passages_and_logs(spark, tmp_path):
    p = lines(tmp_path / "p.jsonl", [{"doc_id": "1", "text": "w " * 30}, {"doc_id": "2", "text": "short"}])
    assert [(r.doc_id, r.license) for r in records.passages(spark, p).collect()] == [("1", "ODC-BY")]
    log = lines(tmp_path / "log.jsonl", [{"step": 1, "tokens": 100, "loss": 2.0}, {"step": 1, "tokens": 100, "held_out_nll": {"real": 3.5}}, "{broken", {"tokens": 0, "held_out_nll": {"real": 1.0}}])
    assert [(r.d, r.loss) for r in records.loss_curves(spark, log, "real", 0.25).collect()] == [(75.0, 3.5)]


def test_metric_trees(spark, tmp_path):
    lines(tmp_path / "m" / "run1" / "eval" / "metrics.json", [{"tasks": {"arc": {"acc": 0.5}, "sciq": {"acc": 0.4, "acc_norm": 0.6}}, "nll": {"real": 2.0}}])
    got = records.metrics_index(spark, f"{tmp_path}/m/*/eval/metrics.json", {"arc": "f1", "sciq": "acc", "none": "acc"}).first()
    assert (got.run, got.arc_f1, got.sciq_acc, got.none_acc) == ("run1", 0.5, 0.4, None)
    lines(tmp_path / "r.json", [{"results": {"arc": {"acc,none": 0.5, "acc,strict": 0.25, "alias": "arc"}}}])
    assert sorted((r.metric, r.value) for r in records.harness_results(spark, f"{tmp_path}/r.json").collect()) == [("acc", 0.5), ("acc,strict", 0.25)]


def test_generations_and_shards(spark, tmp_path):
    p = lines(tmp_path / "g" / "shard-0.jsonl", [{"prompt_id": "a", "teacher": "t", "retained": True, "tokens_student": 5}, {"prompt_id": "b", "teacher": "t", "retained": False, "tokens_student": 7}])
    rows = records.generations(spark, p)
    assert records.generations(spark, p, retained_only=True).count() == 1 and rows.first().shard == "shard-0.jsonl"
    m = sinks.write_shards(rows.drop("flags"), f"{tmp_path}/out").first()
    assert (m.n_offered, m.n_retained, m.tokens_student_retained) == (2, 1, 5) and spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_freeze_pool(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:010d}", f"text {i}") for i in range(50)], "prompt_id string, text string")
    m = sinks.freeze_pool(rows, f"{tmp_path}/a", "1")
    assert m == sinks.freeze_pool(rows.repartition(5), f"{tmp_path}/b", "1") and m["n_records"] == 50 and spark.read.text(f"{tmp_path}/a").count() == 50
    with pytest.raises(ValueError):
        sinks.freeze_pool(rows.where("prompt_id <> '0000000003'"), f"{tmp_path}/c", "1")


def test_union_index(spark):
    got = sinks.union_index([spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS b, 3 AS a")])
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect()), key=str) == [(1, None), (3, 2)]


def test_token_files(spark, tmp_path):
    tokens = np.arange(101, dtype="<u2")
    tokens.tofile(tmp_path / "t.bin")
    sinks.register(spark)
    got = spark.read.format("token_file").option("path", f"{tmp_path}/t.bin").option("length", 10).option("rowsPerPartition", 3).load().orderBy("row").collect()
    assert [r.tokens for r in got] == [tokens[i * 10 : i * 10 + 11].tolist() for i in range(10)]


def test_near_index_joins_heads_only(spark, tmp_path):
    for k, rows in enumerate(([(1, "g", ["a", "b"]), (2, "g", ["a", "c"])], [(3, "g", ["x", "c"]), (4, "g", ["x", "b"]), (5, "h", ["a", "b"])])):
        spark.createDataFrame(rows, "id long, grp string, bands array<string>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long, grp string, bands array<string>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = near_index.near_heads(stream).writeStream.format("memory").queryName("heads").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r["head"] for r in spark.table("heads").collect()}
    assert got[1] == 1 and got[2] == 1 and got[3] == 3 and got[5] == 5 and got[4] in (1, 3)


def test_band_heads_hold_one_number_a_key(spark, tmp_path):
    from textloom.streaming import events

    for k, rows in enumerate(([(1, "g", ["a", "b"]), (2, "g", ["a", "c"])], [(3, "g", ["x", "c"]), (4, "h", ["a", "b"])])):
        spark.createDataFrame(rows, "id long, grp string, bands array<string>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long, grp string, bands array<string>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = events.settled(near_index.band_heads(stream)).groupBy("grp", "id").agg({"head": "min"}).collect()
    heads = {(r.grp, r.id): r["min(head)"] for r in got}
    assert heads in ({("g", 1): 1, ("g", 2): 1, ("g", 3): 2, ("h", 4): 4}, {("g", 1): 1, ("g", 2): 1, ("g", 3): 3, ("h", 4): 4})


def test_harness_samples_of_both_shapes(spark, tmp_path):
    import json

    rows = [
        {"doc_id": 0, "target": 1, "arguments": {"g0": {"arg_0": "q", "arg_1": " no"}, "g1": {"arg_0": "q", "arg_1": " yes, it \"is\""}}, "resps": [[["-3.5", "False"]], [["-4.0", "True"]]], "filtered_resps": [["-3.5", "False"], ["-4.0", "True"]]},
        {"doc_id": 1, "target": "b", "arguments": [["q", " a"], ["q", " b"], ["q", ""]], "resps": [[[-1.0, False]], [[-1e-3, True]], [["-inf", False]]]},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    got = {g.doc_id: g for g in records.harness_samples(spark, f"{tmp_path}/s.jsonl").collect()}
    assert set(got) == {0, 1} and got[0].lls == [-3.5, -4.0] and got[0].is_greedy == [False, True] and got[0].choice_chars == [2, 12]
    assert (got[0].gold, got[0].acc, got[0].acc_norm) == (1, 0.0, 1.0)
    assert got[1].gold == 1 and got[1].lls == [-1.0, -1e-3, float("-inf")] and (got[1].acc, got[1].acc_norm) == (1.0, 1.0)


def test_configurations_compose_and_taxonomies_flatten(spark):
    from textloom.sources import config

    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert config.compose(base, {"a": {"c": 3}}, {"e": 4}, override={"a.b": 9}) == {"a": {"b": 9, "c": 3}, "d": [1], "e": 4} and base["a"]["c"] == 2
    for missing in ("a.x", "q.b", "d.b"):
        with pytest.raises(KeyError):
            config.compose(base, override={missing: 1})
    rows, digest = config.taxonomy(spark, {"s": {"t": ["u", "v"], "w": []}, "x": {"y": ["z"]}})
    assert [tuple(r) for r in rows.orderBy("position").collect()] == [(0, "s", "t", "u"), (1, "s", "t", "v"), (2, "x", "y", "z")] and len(digest) == 64


def test_compressed_lines(spark, tmp_path):
    import zstandard

    from textloom.sources import files

    (tmp_path / "z").mkdir()
    for k in range(3):
        text = "\n".join([json.dumps({"id": 10 * k + i, "text": f"é{i}"}) for i in range(5)] + ["", "{broken"])
        (tmp_path / "z" / f"{k}.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()) + zstandard.ZstdCompressor().compress(b'\n{"id": 100}\n'))
    got = files.compressed_json(spark, f"{tmp_path}/z", "id long, text string").collect()
    assert sorted(x.id for x in got) == sorted([10 * k + i for k in range(3) for i in range(5)] + [100] * 3)


def test_chunks_equal_the_flat_stream(spark):
    from textloom.sources import files

    rows = [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate((3, 0, 17, 1, 40, 2, 2, 9))] + [(20, None)]
    flat = [x for _, t in rows for x in t or []]
    for length in (1, 4, 10, 73, 100):
        got = [(r.seq, r.tokens) for r in files.chunks(spark.createDataFrame(rows, "doc_id long, tokens array<int>").repartition(3), length).orderBy("seq").collect()]
        assert got == [(i, flat[i * length : (i + 1) * length + 1]) for i in range(max(0, (len(flat) - 1) // length))]


def test_token_stream_round_trips_and_refuses(spark, tmp_path):
    from textloom.sources import files

    rows = spark.createDataFrame([(i, [(7 * i + j) % 65536 for j in range(1 + i % 5)]) for i in range(300)], "doc_id long, tokens array<int>").repartition(5)
    flat = [(7 * i + j) % 65536 for i in range(300) for j in range(1 + i % 5)]
    m = files.write_token_stream(rows, f"{tmp_path}/s")
    assert m["n_tokens"] == len(flat) and m["n_docs"] == 300
    np.array(flat[:55], "<u2").tofile(tmp_path / "t.bin")
    sinks.register(spark)
    read = lambda path: [r.tokens for r in spark.read.format("token_file").option("path", path).option("length", 10).option("rowsPerPartition", 7).load().orderBy("row").collect()]
    whole = [flat[i * 10 : i * 10 + 11] for i in range((len(flat) - 1) // 10)]
    assert read(f"{tmp_path}/s") == whole and read(f"{tmp_path}/t.bin,{tmp_path}/s") == [flat[i * 10 : i * 10 + 11] for i in range(5)] + whole
    for bad in ([(1, [70000])], [(1, [1]), (2, [])]):
        with pytest.raises(Exception, match="16 bits|without tokens"):
            files.write_token_stream(spark.createDataFrame(bad, "doc_id long, tokens array<int>"), f"{tmp_path}/bad")


def test_branches(spark, tmp_path):
    from textloom.sources import files

    packed = [(i, list(range(8)), [0, 3], i % 2) for i in range(20)]
    schema = "seq long, tokens array<int>, bounds array<int>, kind int"
    m = files.write_branch(spark.createDataFrame(packed, schema), f"{tmp_path}/b", {"length": 8})
    assert m["n_sequences"] == 20 and m["n_tokens"] == 160 and m["kinds"] == {"0": 10, "1": 10} and json.loads((tmp_path / "b" / "branch.json").read_text()) == m
    assert spark.read.parquet(f"{tmp_path}/b/bounds").count() == 20
    for bounds in ([1, 3], [0, 3, 3], [0, 8], [0, 5, 3], [], None):
        with pytest.raises(ValueError):
            files.write_branch(spark.createDataFrame([(0, list(range(8)), bounds, 0)], schema), f"{tmp_path}/c", {})


def test_tables_are_replaced_whole(spark, tmp_path):
    uri = f"file://{tmp_path}/queue"
    sinks.save_whole(spark.range(5), uri)
    sinks.save_whole(spark.read.parquet(uri).where("id > 2"), uri)
    assert sorted(r.id for r in spark.read.parquet(uri).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["queue"]


def test_indexes_reports_and_results(spark, tmp_path):
    sinks.write_index([spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS b")], f"file://{tmp_path}/i")
    assert records.load_index(spark, f"file://{tmp_path}/i").count() == 2
    spark.read.parquet(f"{tmp_path}/i.parquet").write.option("header", True).csv(f"file://{tmp_path}/j.csv")
    assert sorted(records.load_index(spark, f"file://{tmp_path}/j").columns) == ["a", "b"]
    sinks.write_results(spark.sql("SELECT 'r' AS run_id, 't' AS task, 0.5 AS acc"), f"{tmp_path}/res")
    assert spark.read.json(f"{tmp_path}/res/run_id=r/task=t").first().acc == 0.5


def test_study_notes_failures_and_goes_on(spark, tmp_path):
    from textloom.operators import analysis

    calls = []
    queries = {"good": lambda s, d: calls.append(d) or s.sql("SELECT 1 AS a, array(1, 2) AS b"), "bad": lambda s, d: s.sql("SELECT nothing")}
    first = analysis.run_study(spark, "x", f"file://{tmp_path}/r", queries, ("good", "bad"))
    again = analysis.run_study(spark, "x", f"file://{tmp_path}/r", queries, ("good", "bad"))
    assert first["good"] == "written" and first["bad"].startswith("failed") and again["good"] == "was there" and calls == ["x"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/good.csv").first().b == "[1,2]"


def test_manifests_fixtures_and_likelihoods(spark, tmp_path):
    for name, arm, data in (("a", "main", {"d_syn": 5.0}), ("b", "base_only", {}), ("c", "other", {"replay": 0.5})):
        lines(tmp_path / "m" / f"{name}.json", [{"run_id": name, "arm": arm, "student": "s", "teacher": "t", "seed": 1, "data": data, "train": {"tokens": 9.0}}])
    points = spark.createDataFrame([("a", float(i), 1.0) for i in range(4)] + [("c", 1.0, 1.0)], "run_id string, d double, loss double")
    rows = {r.run_id: r for r in records.run_covariates(spark, f"{tmp_path}/m/*.json", {"main": "C2", "other": "C3"}).collect()}
    assert set(rows) == {"a", "c"} and (rows["a"].cond, rows["a"].replay, rows["a"].d_syn) == ("C2", 0.25, 5.0) and (rows["c"].replay, rows["c"].d_syn) == (0.5, 9.0)
    assert [r.run_id for r in records.run_covariates(spark, f"{tmp_path}/m/*.json", {}, points).collect()] == ["a"]
    lines(tmp_path / "f.json", [json.dumps([{"context": "q", "options": ["x", "y"], "gold": 1}, {"context": "q", "options": ["x"], "gold": 3}])])
    assert [(r.context, r.gold) for r in records.choice_items(spark, f"{tmp_path}/f.json").collect()] == [("q", 1)]
    p = lines(tmp_path / "l.jsonl", [{"doc_id": 0, "resps": [[[-2.5, True]]]}, {"doc_id": 1, "resps": [[["-inf", "False"]]]}])
    assert [(r.ll, r.is_greedy) for r in records.harness_likelihoods(spark, p).orderBy("doc_id").collect()] == [(-2.5, True), (float("-inf"), False)]
    p = lines(tmp_path / "g.jsonl", [{"doc_id": 0, "target": "Paris", "resps": [[" paris "]]}, {"doc_id": 1, "target": "x", "filtered_resps": ["y"], "resps": [["x"]]}])
    assert [(r.answer, r.matched) for r in records.harness_generations(spark, p).orderBy("doc_id").collect()] == [("paris", True), ("y", False)]


def test_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    from textloom.sources import config

    (tmp_path / "a.yaml").write_text("x: {y: 1}\nz: 2\n")
    (tmp_path / "b.yaml").write_text("x: {w: 3}\n")
    assert config.composed_files(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), override={"z": 5}) == {"x": {"y": 1, "w": 3}, "z": 5}
    (tmp_path / "t.yaml").write_text("d: {s: [l1, l2]}\n")
    assert config.taxonomy_file(spark, str(tmp_path / "t.yaml"))[0].count() == 2


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    from textloom.streaming import events

    def put(k, rows):
        spark.createDataFrame(rows, "worker string, shard long, tokens long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema("worker string, shard long, tokens long").parquet(f"{tmp_path}/in/*")
        return sorted((r.worker, r.shard) for r in events.settled(events.until_budget(stream, 10), base=f"file://{tmp_path}/out").collect())

    put(0, [("a", 1, 4), ("a", 2, 4), ("b", 1, 99)])
    assert run() == [("a", 1), ("a", 2), ("b", 1)]
    put(1, [("a", 3, 4), ("a", 4, 4), ("b", 2, 1)])
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from textloom.operators import folders

    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("D", (), {"get": staticmethod(lambda *a: None)})())})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.checkpoint_root(Other())
