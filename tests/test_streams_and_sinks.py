"""Byte ranges, running statistics and committed reports."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from codestrata.sources import byte_ranges, report_sink
from codestrata.streaming import chunks, running


def put(root, name, data, mode="wb"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def shown(rows):
    return sorted((r.repo, r.path, r.chunk_no, r.offset, r.total, bytes(r.data) if r.data is not None else None) for r in rows)


def test_ranges_of_a_tree(spark, tmp_path):
    root = str(tmp_path / "t")
    put(root, "a/x/long", b"0123456789" * 5)
    put(root, "a/.empty", b"")
    put(root, "b/exact", b"abcdefgh")
    want = sorted(
        [("a", "x/long", i, 8 * i, 50, (b"0123456789" * 5)[8 * i : 8 * i + 8]) for i in range(7)]
        + [("a", ".empty", 0, 0, 0, b""), ("b", "exact", 0, 0, 8, b"abcdefgh")]
    )
    for split in (1, 16, 10**6):
        got = byte_ranges.read_ranges(spark, root, 8, split)
        assert shown(got.collect()) == want
    assert got.rdd.getNumPartitions() == 1 and byte_ranges.read_ranges(spark, root, 8, 16).rdd.getNumPartitions() >= 4
    one = byte_ranges.read_ranges(spark, root, 100, repo="all").collect()
    assert {(r.repo, r.path) for r in one} == {("all", "a/x/long"), ("all", "a/.empty"), ("all", "b/exact")}
    assert byte_ranges.read_ranges(spark, str(tmp_path / "nothing"), 8).count() == 0


def test_a_vanished_file_is_an_error_row(tmp_path):
    root = str(tmp_path / "t")
    put(root, "a/x", b"12345678")
    layout = byte_ranges._Layout({"path": root, "chunk": "3"})
    parts = layout.deal(iter([("a/x", 0, 12, 12), ("a/gone", 0, 5, 5)]))
    rows = [r for p in parts for b in layout.rows(p) for r in b.to_pylist()]
    assert [(r["path"], r["offset"], r["data"]) for r in rows if r["error"] is None] == [("x", 0, b"123"), ("x", 3, b"456")]
    assert [(r["path"], r["offset"]) for r in rows if r["error"]] == [("x", 6), ("gone", 0)]
    with pytest.raises(ValueError):
        byte_ranges._Layout({"path": root, "chunk": "0"})


def test_stream_reads_each_new_range_once(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put(root, "r/log", b"0123456789")
    put(root, "r/rotated", b"old content")

    def follow():
        stream = byte_ranges.stream_ranges(spark, root, 4)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return {(r.path, r.offset, bytes(r.data)) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    first, n = follow()
    assert n == 6 and ("log", 8, b"89") in first
    again, same = follow()
    assert (again, same) == (first, n)
    put(root, "r/log", b"abcdef", "ab")
    put(root, "r/rotated", b"new")
    put(root, "s/fresh", b"!")
    more, total = follow()
    # the started chunk goes on where it stopped, the replaced file starts anew
    assert more - first == {("log", 10, b"ab"), ("log", 12, b"cdef"), ("rotated", 0, b"new"), ("fresh", 0, b"!")} and total == n + 4


def test_running_statistics_over_several_runs(spark, tmp_path):
    root, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "repo string, path string, content string"

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(root)
        source = spark.readStream.schema(schema).parquet(root)
        cut = chunks.checked_chunks(source, 10, limit=50)
        at = F.timestamp_seconds(F.regexp_extract("path", r"(\d+)", 1).cast("long"))
        running.stream_running_stats(running.running_stats(cut, at, large=20, slices=4), sink, checkpoint).awaitTermination()
        stats = running.merged(running.newest(spark.read.parquet(out)))
        return {r.repo: r for r in stats.collect()}, {r.repo: r.text for r in running.summary_text(stats).collect()}

    got, text = run([("r", f"f{i}", "x" * i) for i in range(0, 60, 3)] + [("s", "g1", None)])
    r = got["r"]
    sizes = [i for i in range(0, 60, 3) if i <= 50]
    assert (r.files, r.bytes, r.chunks, r.errors) == (len(sizes), sum(sizes), sum(max(1, -(-n // 10)) for n in sizes), 3)
    assert r.large_files == len([n for n in sizes if n > 20]) == len(r.large_names)
    assert (r.elapsed_sec, r.bytes_per_sec) == (57.0, sum(sizes) / 57)
    assert got["s"].errors == 1 and got["s"].first_errors == ["g1: no content"] and got["s"].bytes_per_sec == 0
    assert "more" not in text["r"]
    # state goes on: earlier errors stay in front, sums add up
    got, text = run([("r", f"late{i}", "y" * 99) for i in range(50, 90)])
    assert got["r"].errors == 43 and got["r"].files == len(sizes) and got["r"].elapsed_sec == 89.0
    limit = " bytes are above the limit of 50"
    assert got["r"].first_errors == ["late50: 99" + limit, "f51: 51" + limit, "late51: 99" + limit, "late52: 99" + limit, "late53: 99" + limit]
    assert text["r"].endswith(f"  - late53: 99{limit}\n  ... and 38 more\n") and "Errors (43):" in text["r"]


ROWS = [("a", 1, None, ["x", "<&>"]), ("b", 2, 'say "é"\x01', []), ("c", 3, "last", ["y"])]


def document(location):
    return "".join(open(p, encoding="utf-8").read() for p in report_sink.committed_parts(location))


def test_committed_reports_are_whole_documents(spark, tmp_path):
    folder = str(tmp_path / "reports")
    df = spark.createDataFrame(ROWS, "k string, n int, text string, items array<string>").repartition(3)
    where = report_sink.commit_report(df, "json", folder, "r1", "repo", ["k"])
    assert os.path.basename(where) == "repo_prompt_r1.json"
    head, *rows = json.loads(document(where))
    assert head == {"run": "r1", "prefix": "repo", "rows": 3} and [r["k"] for r in rows] == ["a", "b", "c"] and rows[1]["text"] == 'say "é"\x01'
    tree = ElementTree.fromstring(document(report_sink.commit_report(df, "xml", folder, "r1", order=["k"])))
    assert [r.findtext("k") for r in tree] == ["a", "b", "c"] and [i.text for i in tree[0].findall("items")] == ["x", "<&>"] and tree.get("rows") == "3"
    assert document(report_sink.commit_report(df, "txt", folder, "r1", order=["k"])) == '\nsay "é"\x01\nlast\n'
    # the same run again: one report, of the new rows alone; another run beside it
    report_sink.commit_report(df.filter("n > 1"), "json", folder, "r1", "repo", ["k"])
    report_sink.commit_report(df.limit(0), "json", folder, "r2", "repo", ["k"])
    assert len(json.loads(document(where))) == 3 and json.loads(document(f"{folder}/repo_prompt_r2.json"))[0]["rows"] == 0
    assert sorted(os.listdir(folder)) == ["prompt_r1.txt", "prompt_r1.xml", "repo_prompt_r1.json", "repo_prompt_r2.json"]


def test_a_failed_run_leaves_the_earlier_report(spark, tmp_path):
    folder = str(tmp_path / "reports")
    df = spark.range(20).select(F.col("id"), F.col("id").cast("string").alias("text"))
    where = report_sink.commit_report(df, "txt", folder, "r1", order=["id"])
    bad = df.withColumn("text", F.when(F.col("id") < 15, F.col("text")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        report_sink.commit_report(bad, "txt", folder, "r1", order=["id"])
    assert document(where) == "".join(f"{i}\n" for i in range(20)) and os.listdir(folder) == ["prompt_r1.txt"]
    for run, kind in (("", "txt"), ("a/b", "txt"), ("r", "pdf")):
        with pytest.raises(ValueError):
            report_sink.report_name(run, kind)
    report_sink.ship_package(spark)
    with pytest.raises(Exception, match="column text"):
        spark.range(1).write.format("report").options(path=folder, run="q", kind="txt").mode("append").save()


def test_stream_queries_read_a_table_in_several_files(spark, tmp_path):
    """A large table is a folder of files, a small one a lone file; both give the same rows."""
    from codestrata.plans.stream_plans import QUERIES

    rows = [(i, f"text {i} " * i, "en", "s", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder, lone = tmp_path / "folder", tmp_path / "lone"
    docs.repartition(3, "doc_id").write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(lone / "made"))
    (lone / "documents.parquet").write_bytes(next((lone / "made").glob("part-*")).read_bytes())
    for name in ("stream_files", "streaming_stats_stream", "running_stats"):
        of_folder, of_lone = (sorted(map(str, QUERIES[name](spark, str(d)).collect())) for d in (folder, lone))
        assert of_folder == of_lone and of_folder


def test_ranges_of_many_files_stay_few_tasks():
    layout = byte_ranges._Layout({"path": "/x", "chunk": "4096", "split": "8192"})
    ranges = [(f"r/{i}", 0, 5000 + i % 7000, 5000 + i % 7000) for i in range(20_000)] + [("r/large", 100, 50_000_000, 50_000_000), ("r/empty", 0, 0, 0)]
    parts = layout.deal(iter(ranges))
    assert len(parts) <= 2 * byte_ranges.MOST_TASKS
    dealt = {}
    for file, start, stop, size in (x for p in parts for x in p.ranges):
        first, at = dealt.get(file, (start, start))
        assert start == at and (start % 4096 == 0 or start == first)
        dealt[file] = (first, stop)
    assert [(f, *dealt[f]) for f, *_ in ranges] == [r[:3] for r in ranges]
    # a few files are still cut at the split
    assert len(layout.deal([("r/a", 0, 30_000, 30_000)])) == 4


def test_graph_sink_reads_its_nodes_once(spark, tmp_path):
    from codestrata.operators.tree import to_dot, tree_edges, tree_nodes
    from codestrata.sources.sinks import write_graph

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(path):
        read.add(1)
        return path

    files = spark.createDataFrame([("r", f"d{k % 7}/f{k}.py") for k in range(50)], "repo string, path string")
    nodes = tree_nodes(files).withColumn("node_path", seen.asNondeterministic()("node_path"))
    write_graph(to_dot(tree_edges(nodes)), str(tmp_path / "graph"))
    assert read.value == 50 + 7 + 1
    assert spark.read.text(str(tmp_path / "graph")).count() == 2 * (50 + 7 + 1) - 1 + 2
