"""Chunk and streaming queries."""

from pyspark.sql import functions as F

from codestrata.plans.corpora import duck, load
from codestrata.session import scratch_path
from codestrata.sources.byte_ranges import read_ranges, stream_ranges
from codestrata.sources.scan import write_tree
from codestrata.streaming import chunks, running

SIZE = 4096
#: Bytes above which a file is refused, or is counted as large.
LIMIT, LARGE = 30_000, 12_000
#: Bytes of a range task, so that long documents are read by several.
SPLIT = 8192


def _stream_source(spark, sf):
    """The documents table, one file or a folder of them, as a stream of files."""
    table = f"{sf}/documents.parquet"
    # streams take a lone file only by a pattern, a folder by either
    raw = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{sf}/documents[.]parquet")
    return raw.select(
        F.col("source").alias("repo"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


def _shown(rows):
    return rows.select("repo", "path", "chunk_no", "offset", "total", F.upper(F.md5("data")).alias("data_md5"))


def _stream_files(spark, sf):
    out, checkpoint = scratch_path(spark, "chunks"), scratch_path(spark, "chunks-checkpoint")
    chunks.stream_chunks(_stream_source(spark, sf), out, checkpoint, SIZE).awaitTermination()
    return _shown(spark.read.parquet(out))


def _stream_stats(spark, sf):
    """Totals kept by the stream; the newest row per repository is the result."""
    out, checkpoint = scratch_path(spark, "stats"), scratch_path(spark, "stats-checkpoint")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    chunks.stream_stats(_stream_source(spark, sf), sink, checkpoint, SIZE).awaitTermination()
    names = ["files", "bytes", "chunks", "large_files"]
    newest = spark.read.parquet(out).groupBy("repo").agg(F.max_by(F.struct(*names), "batch_id").alias("_s"))
    return newest.select("repo", "_s.*")


def _running_stats(spark, sf):
    """Statistics kept as state; time goes by the number of the document."""
    out, checkpoint = scratch_path(spark, "running"), scratch_path(spark, "running-checkpoint")

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    rows = chunks.checked_chunks(_stream_source(spark, sf), SIZE, LIMIT)
    at = F.timestamp_seconds(F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    running.stream_running_stats(running.running_stats(rows, at, LARGE), sink, checkpoint).awaitTermination()
    stats = running.merged(running.newest(spark.read.parquet(out)))
    return stats.withColumns({c: F.array_join(c, "|") for c in ("first_errors", "large_names")})


def _grow(spark, sf, root, content):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_tree(docs.selectExpr("source as repo", "concat(lang, '/', doc_id, '.txt') as path", f"{content} as content"), root)


def _range_rows(rows):
    return rows.select(
        "repo", "path", "chunk_no", "offset", "total", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("digest"), "error"
    )


def _stream_ranges(spark, sf):
    """A tree of half-written documents, followed while the other halves are appended."""
    root = scratch_path(spark, "growing").removeprefix("file://").removeprefix("file:")
    out, checkpoint = scratch_path(spark, "ranges"), scratch_path(spark, "ranges-checkpoint")
    for content in ("left(text, cast(length(text) div 2 as int))", "text"):
        _grow(spark, sf, root, content)
        stream = stream_ranges(spark, root, SIZE, SPLIT)
        (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)).awaitTermination()
    return _range_rows(spark.read.parquet(out))


def _read_ranges(spark, sf):
    root = scratch_path(spark, "ranges-tree").removeprefix("file://").removeprefix("file:")
    _grow(spark, sf, root, "text")
    return _range_rows(read_ranges(spark, root, SIZE, SPLIT))


QUERIES = {
    "read_ranges": _read_ranges,
    "stream_ranges": _stream_ranges,
    "running_stats": _running_stats,
    "chunk_files": lambda s, d: _shown(chunks.chunk_files(load(s, d, "docs"), SIZE)),
    "stream_files": _stream_files,
    "streaming_stats": lambda s, d: chunks.streaming_stats(chunks.chunk_files(load(s, d, "docs"), SIZE)),
    "streaming_stats_stream": _stream_stats,
}

# --- oracle: bytes of a chunk cut from the hex text --------------------------------

_CHUNKS = (
    f"select repo, path, n as chunk_no, n * {SIZE} as \"offset\", total, upper(md5(unhex(substr(h, (n * {SIZE} * 2 + 1)::bigint, {SIZE * 2})))) as data_md5 from "
    f"(select repo, path, hex(encode(content)) as h, strlen(content) as total, unnest(generate_series(0, greatest(strlen(content) - 1, 0) // {SIZE})) as n "
    f"from ({duck('docs')}))"
)
_STATS = (
    f"select repo, count(*)::bigint as files, sum(strlen(content))::bigint as bytes, sum(greatest(strlen(content) - 1, 0) // {SIZE} + 1)::bigint as chunks, "
    f"count_if(strlen(content) > 104857600)::bigint as large_files from ({duck('docs')}) group by repo"
)

_TEXTS = (
    "select source as repo, lang || '/' || doc_id || '.txt' as path, text, strlen(text) as n, "
    "strlen(left(text, length(text) // 2)) as h from (select * replace (coalesce(text, '') as text) from documents)"
)


def _ranges(starts, total, where="true"):
    return (
        f"select repo, path, start // {SIZE} as chunk_no, start as \"offset\", {total} as total, stop - start as bytes, "
        f"md5(encode(text)[start + 1 : stop]) as digest, null::varchar as error from ("
        f"select *, least({total}, (start // {SIZE} + 1) * {SIZE}) as stop from (select *, unnest({starts}) as start from ({_TEXTS}) where {where}))"
    )


_RUNNING = f"""
with files as (
  select source as repo, lang || '/' || doc_id || '.txt' as path, doc_id, strlen(text) as total,
         case when text is null then 'no content' when strlen(text) > {LIMIT} then strlen(text) || ' bytes are above the limit of {LIMIT}' end as error
  from documents)
select repo, count_if(error is null)::bigint as files, coalesce(sum(total) filter (error is null), 0)::bigint as bytes,
       coalesce(sum(greatest(total - 1, 0) // {SIZE} + 1) filter (error is null), 0)::bigint as chunks,
       count_if(error is null and total > {LARGE})::bigint as large_files, count_if(error is not null)::bigint as errors,
       (max(doc_id) - min(doc_id))::double as elapsed_sec,
       case when max(doc_id) > min(doc_id) then coalesce(sum(total) filter (error is null), 0)::double / (max(doc_id) - min(doc_id)) else 0 end as bytes_per_sec,
       coalesce(array_to_string(list_slice(list(path || ': ' || error order by doc_id, error) filter (error is not null), 1, {running.SHOWN}), '|'), '') as first_errors,
       coalesce(array_to_string(list(path order by path) filter (error is null and total > {LARGE}), '|'), '') as large_names
from files group by repo
"""

ORACLES = {
    "read_ranges": _ranges(f"range(0, greatest(n, 1), {SIZE})", "n"),
    "stream_ranges": _ranges(f"range(0, greatest(h, 1), {SIZE})", "h") + " union all "
    + _ranges(f"list_concat([h], list_filter(range(0, n, {SIZE}), lambda x: x > h))", "n", "n > h"),
    "running_stats": _RUNNING,
    "chunk_files": _CHUNKS,
    "stream_files": _CHUNKS,
    "streaming_stats": _STATS,
    "streaming_stats_stream": _STATS,
}
