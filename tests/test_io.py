import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import packing as P
from millrace.sinks import writers as K
from millrace.sources import logs, readers, specs
from millrace.streaming import routing as streams


def test_specs():
    assert specs.parse_source("a::b::test::body") == specs.Source("a", "b", "test", "body")
    assert specs.parse_source("a::::valid") == specs.Source("a", None, "valid", "text") and specs.parse_source("a::b").label == "a::b"
    for bad in ("", "::x", "a::b::c::d::e"):
        with pytest.raises(ValueError):
            specs.parse_source(bad)
    assert specs.weights_and_paths(["0.3", "p", "0.7", "q "]) == ([0.3, 0.7], ["p", "q"])
    assert specs.replay({"sources": ["a", "b"], "seed": 5}, {"seed": None})["seeds"] == [5, 6]
    with pytest.raises(ValueError):
        specs.replay({"jsonl": "x"}, {})


def test_jsonl(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text": "é"}\n\n{"other": 1}\n{"text": null}\n')
    assert [r.text for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl.gz")).collect()] == ["é"]
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "train.jsonl").write_text('{"content": "y"}\n{"text": "x", "content": "z"}\n')
    assert sorted(r.text for r in readers.read_source(spark, specs.parse_source("d"), str(tmp_path)).collect()) == ["x", "y"]


def test_registry_and_headers(tmp_path):
    good = {"tokenizers": [{"id": 0, "tokenizer_name_or_path": "./t"}, {"id": 1, "tokenizer_name_or_path": None}]}
    (tmp_path / "r.json").write_text(json.dumps(good))
    assert readers.read_registry(str(tmp_path / "r.json"))[0]["tokenizer_name_or_path"] == str(tmp_path / "t")
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1}, {"id": 0}]))
    with pytest.raises(ValueError):
        readers.read_registry(str(tmp_path / "r.json"))
    (tmp_path / "e.json").write_text(json.dumps({"endpoints": [{"id": 1}, {"id": 0}]}))
    assert [e["id"] for e in readers.endpoints_of(str(tmp_path / "e.json"))] == [0, 1]
    (tmp_path / "a").write_text("name|2\n1\n")
    (tmp_path / "b").write_text("name|4\n1\n")
    with pytest.raises(ValueError):
        readers.same_header([str(tmp_path / "a"), str(tmp_path / "b")])
    assert readers.match_paths(["r/a/x.ds", "r/x.txt"], "r", r".*\.ds") == ["r/a/x.ds"]


def test_indexed_files(spark, tmp_path):
    docs = [np.array([1, 2, 3]), np.array([], dtype=int), np.array([70_000])]
    readers.write_indexed(str(tmp_path / "i"), docs)
    got = {r.doc: r.ids for r in readers.read_indexed(spark, str(tmp_path / "i"), 2).collect()}
    assert got == {0: [1, 2, 3], 1: [], 2: [70_000]}
    assert readers.document_slice(str(tmp_path / "i"), 0, 1, 1).tolist() == [2]


def test_token_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(g, s, [g * 100 + s * 10 + k for k in range(4)]) for g in (0, 1) for s in range(5)], "g int, seq_id bigint, input_ids array<int>")
    report = K.write_token_files(rows, str(tmp_path), "g", per_file=2).collect()
    assert sorted((r.g, r.file, r.sequences, r.tokens) for r in report) == [(g, f, n, 4 * n) for g in (0, 1) for f, n in ((0, 2), (1, 2), (2, 1))]
    back = readers.read_token_stream(spark, str(tmp_path), 3).collect()
    assert sorted(r.input_ids for r in back) == sorted(r.input_ids for r in rows.collect())
    assert readers.read_token_stream(spark, str(tmp_path), 3, skip=1).count() == 4


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train", 0), (2, "é", "eval", 1)], "id int, source string, partition string, shard int")
    K.write_curated(rows, str(tmp_path / "c"))
    K.write_curated(rows.where("id = 2"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    K.write_shards(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    K.write_manifest(str(tmp_path / "m.json"), {"format_version": 1, "b": 2, "a": 1})
    assert K.read_manifest(str(tmp_path / "m.json"))["a"] == 1
    with pytest.raises(ValueError):
        K.read_manifest(str(tmp_path / "m.json"), 2)
    for _ in range(2):
        K.append_report(rows.select("id"), str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 4


def test_logs(spark):
    lines = ["\x1b[1miteration: 1 / 10 x lm_loss: 3.5\x1b[0m", "noise", None, "iteration: 2 / 10 lm_loss: 3.25", "iteration: 1 / 10 lm_loss: 3.0"]
    df = spark.createDataFrame(list(zip(lines, range(5))), "value string, line_no long")
    assert sorted((r.step, r.loss) for r in logs.losses(df).collect()) == [(1, 3.0), (2, 3.25)]


def test_routed_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n: (tmp_path / "in" / f"{n}.json").write_text('{"text": "some words here", "source_document_index": %d}\n{"source_document_index": 9}\n' % n)
    run = lambda: streams.route_shards(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put(1)
    run()
    put(2)
    run()
    run()
    assert sorted(r.source_document_index for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]


def test_scheduled_stream(spark, tmp_path):
    from millrace.operators.schedule import DeficitSchedule

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"run_name": "r", "requests": 30}\n')
    rows = spark.readStream.schema("run_name string, requests bigint").json(str(tmp_path / "in"))
    query = streams.scheduled_stream(rows, [0.7, 0.3], 5).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    own = DeficitSchedule([0.7, 0.3], 5)
    assert [r.tokenizer_id for r in spark.table("steps").orderBy("step").collect()] == [own.next() for _ in range(30)]


def test_first_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "x"}\n{"text": "x"}\n{"text": "y"}\n{}\n')
    rows = spark.readStream.schema("text string").json(str(tmp_path / "in"))
    query = streams.first_seen(rows).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.table("seen").collect()) == ["x", "y"]


def test_synthetic(spark):
    rows = readers.synthetic_rows(spark, 9, 1)
    assert rows.where(F.size(F.split("text", " ")) == 60).count() == 9 and readers.dummy_batches(spark, 2, 12, 50, 1).first().position_ids == [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 0, 1]


def test_converted_tokenizer(tmp_path):
    from millrace.functions.tokenizers import fit_bpe

    out = K.convert_tokenizer(fit_bpe(["some text"], 300), str(tmp_path / "t"), {"tokenizer_name": "x"})
    assert out["special_token_ids"]["<eos>"] == 3 and K.read_manifest(str(tmp_path / "t" / "manifest.json")) == out
    from tokenizers import Tokenizer, models

    with pytest.raises(ValueError):
        K.convert_tokenizer(Tokenizer(models.BPE()).to_str(), str(tmp_path / "u"), {})


def test_event_totals_count_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = ["2031-03-03T00:01:00", "2031-03-03T00:12:00", "2031-03-03T00:02:00", "2031-03-03T05:00:00"]
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"ts": t, "event_type": "a", "value": 2.0}) + "\n" for t in rows))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "in"))
    query = streams.event_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.events, r.value) for r in spark.table("totals").collect()) == [(1, 2.0), (1, 2.0), (2, 4.0)]


def test_files_are_listed_and_streamed_by_ranges(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, n in (("x.ds", 10), ("a/y.ds", 70), ("a/b/z.txt", 5), ("a/b/w.ds", 0)):
        (tmp_path / name).write_bytes(bytes(range(n)))
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert sorted(r.relative for r in files.list_files(spark, root).collect()) == ["a/b/z.txt", "a/y.ds", "x.ds"]
        found = files.list_files(spark, root, r"(a/)?[a-z]\.ds").collect()
        assert sorted((r.relative, r.length) for r in found) == [("a/y.ds", 70), ("x.ds", 10)]
        parts = {}
        for r in sorted(files.stream_file(spark, root, r".*\.ds", chunk=16, offset=3).collect(), key=lambda r: (r.path, r.offset)):
            assert len(r.data) == r.size <= 16
            parts[r.path.rsplit("/", 1)[1]] = parts.get(r.path.rsplit("/", 1)[1], b"") + bytes(r.data)
        assert parts == {"x.ds": bytes(range(3, 10)), "y.ds": bytes(range(3, 70))}
        assert files.exists(f"{root.rstrip('/')}/x.ds") and not files.exists(f"{root.rstrip('/')}/no.ds")


def test_token_folders_count_across_files(spark, tmp_path):
    import numpy as np

    for k in (0, 1):
        (tmp_path / "f" / f"{k}.ds").parent.mkdir(exist_ok=True)
        (tmp_path / "f" / f"{k}.ds").write_bytes(np.arange(100 * k, 100 * k + 11, dtype="<u2").tobytes())
    rows = sorted(readers.read_token_folders(spark, [str(tmp_path / "f")], 3).collect(), key=lambda r: r.context)
    assert [(r.context, r.file_context, r.input_ids[0]) for r in rows] == [(0, 0, 0), (1, 1, 4), (2, 0, 100), (3, 1, 104)]
    some = readers.read_token_folders(spark, [str(tmp_path / "f")], 3, most_tokens=8, skip_tokens=4).collect()
    assert sorted((r.context, r.input_ids[0]) for r in some) == [(0, 4), (1, 100)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.read_token_folders(spark, [str(tmp_path / "none")], 3)


def test_indexed_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i, i + 1][: i % 3]) for i in range(20)] + [(99, None)], "k bigint, ids array<int>")
    report = K.write_indexed_parts(rows, str(tmp_path / "p"), "k", "ids", per_file=8).orderBy("part").collect()
    back = [r.ids for p in report for r in readers.read_indexed(spark, f"{tmp_path}/p/part-{p.part:05d}").orderBy("doc").collect()]
    assert back == [[i, i + 1][: i % 3] for i in range(20)] + [[]] and sum(r.documents for r in report) == 21 and len(report) == 3


def test_token_rows(spark):
    rows = spark.createDataFrame([(1, [5, 9, 6, 7, 9, 8], [1, 2]), (2, [9, 9], []), (3, [4], None), (4, [], [1]), (5, None, None)], "k int, ids array<int>, p array<int>")
    got = {r.k: r for r in rows.select("k", F.inline(F.array(P.collated(F.col("ids"), 9)))).collect()}
    assert got[1].position_ids == [0, 1, 0, 1, 2] and got[1].label_mask == [True, False, True, True, False] and got[1].label_ids == [9, 6, 7, 9, 8]
    assert got[2].position_ids == [0] and got[2].label_mask == [False] and got[3].input_ids == [] and got[4].label_mask == [] and got[5].input_ids == []
    sft = {r.k: r for r in rows.select("k", F.inline(F.array(P.supervised_rows(F.col("p"), F.col("ids"), 4, 9, 0)))).collect()}
    assert sft[1].input_ids == [1, 2, 5, 9, 6] and sft[1].label_mask == [False, False, True, True, True] and sft[1].position_ids == [0, 1, 2, 3, 4]
    assert sft[3].input_ids == [4, 9, 0, 0, 0] and sft[3].position_ids == [0, 1, -1, -1, -1] and sft[3].attention_mask == [True, True, False, False, False]
    assert sft[4].label_mask == [False, True, False, False, False] and sft[5].label_mask == [True, False, False, False, False]
    padded = {r.k: r for r in P.padded_rows(rows.withColumn("b", F.lit(0)), ["b"], "ids", 0).collect()}
    assert padded[3].ids == [4, 0, 0, 0, 0, 0] and padded[3].attention_mask == [True] + [False] * 5 and padded[5].ids == [0] * 6
    x = F.array(*map(F.lit, range(10)))
    assert sum((rows.limit(1).select(P.context_slice(x, r, 4).alias("s")).first().s for r in range(4)), []) == list(range(10))
    assert P.one_tokenizer(rows.withColumn("b", F.col("k")), ["b"], "k").count() == 5
    with pytest.raises(Exception, match="mixes"):
        P.one_tokenizer(rows.withColumn("b", F.lit(0)), ["b"], "k").collect()
    ids = F.col("ids")
    e = rows.where("k = 2").select(P.encoded_document(ids, 1, 2).alias("a"), P.encoded_document(ids, 1).alias("b"), P.encoded_document(ids).alias("c")).first()
    assert (e.a, e.b, e.c) == ([2, 9, 9, 2], [1, 9, 9], [9, 9])


def test_runs_are_written_and_read_back(spark, tmp_path):
    from millrace.functions.tokenizers import fit_bpe
    from millrace.sources import runs

    docs = spark.createDataFrame([(0, "a b", "x", 3, 2, 1, [5, 4], [0.0, 1.0]), (1, "c", "y", 1, 1, 0, [1, 2], [1.0, 0.0])], "doc_id bigint, text string, source string, raw_bytes bigint, budget_tokens bigint, expert_id int, costs array<bigint>, weights array<double>")
    experts = [fit_bpe(["a b"], 300), fit_bpe(["c"], 300)]
    for folder in (str(tmp_path / "r"), f"file://{tmp_path}/s"):
        out = runs.write_run(folder, docs, experts, {"objective": 7.0})
        assert out["sample_documents"] == 2 and out["experts"][1]["expert_tokens"] == 4 and json.loads((tmp_path / folder[-1] / "summary.json").read_text())["objective"] == 7.0
        sample = runs.read_sample(spark, folder)
        assert {r.doc_id: r.text for r in sample.collect()} == {0: "a b", 1: "c"} and runs.read_experts(folder) == experts
        assert {r.doc_id: r.expert_id for r in runs.read_labels(spark, folder, sample).collect()} == {0: 1, 1: 0}
        with pytest.raises(ValueError, match=r"missing.*\[5\]"):
            runs.read_labels(spark, folder, sample.unionByName(spark.createDataFrame([(5, "", 0, 0)], sample.schema)))
        with pytest.raises(ValueError, match=r"unexpected.*\[1\]"):
            runs.read_labels(spark, folder, sample.where("doc_id = 0"))
    for read in (lambda: runs.read_sample(spark, str(tmp_path)), lambda: runs.read_labels(spark, str(tmp_path), sample), lambda: runs.read_experts(str(tmp_path))):
        with pytest.raises(FileNotFoundError):
            read()
