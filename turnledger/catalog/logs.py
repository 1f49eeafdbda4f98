"""Log folders in the three dialects, written from the sample tables.

The lines carry the irregularities real logs have: missing fields, numbers as strings,
several time formats, truncated lines, replayed messages, and message text that must
not leave the reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.catalog.adapters import event_model, table
from turnledger.session import scratch_path
from turnledger.sources.files import Source, list_files
from turnledger.sources.ranges import can_open, open_store

# Spark's text sink names its files this way.
TEXT_GLOB = "*.txt"


def _pair(name: str, value: Column) -> Column:
    """``"name":value`` for a ready JSON value; null (left out) for a null value."""
    return F.concat(F.lit(f'"{name}":'), value)


def _text(value: Column) -> Column:
    """A JSON string, escaped."""
    quoted = F.to_json(F.struct(value.alias("t")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def _object(*pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _number(value: Column) -> Column:
    return value.cast("string")


def _iso(seconds: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return _text(F.concat(stamp, F.lit(".000Z")))


def _write(lines: DataFrame, folder: str) -> None:
    lines.select("value").write.text(folder)


def _write_by_conversation(lines: DataFrame, folder: str) -> None:
    """One file a conversation. ``lines`` lie by ``conv_id`` and in its order.

    Spark's sink starts a process for the permissions of every local file, so the files are
    written with Arrow where it knows the store.
    """
    if can_open(folder):
        lines.select("conv_id", "value").mapInArrow(partial(_write_files, folder), "n bigint").write.format(
            "noop"
        ).mode("overwrite").save()
    else:
        lines.select("conv_id", "value").write.partitionBy("conv_id").text(folder)


def _write_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, base = open_store(folder)
    held, values, n = None, [], 0

    def finish() -> None:
        own = f"{base}/conv_id={held}"
        store.create_dir(own)
        # Written aside first: a second attempt of the task leaves whole files too.
        aside = f"{own}/.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as out:
            out.write("".join(f"{value}\n" for value in values).encode())
        store.move(aside, f"{own}/log-{held}.txt")

    for batch in batches:
        for conv_id, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if conv_id != held and values:
                finish()
                values, n = [], n + 1
            held = conv_id
            values.append("" if value is None else value)
    if values:
        finish()
        n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def write_message_logs(spark: SparkSession, sf_dir: str) -> Source:
    """``events`` as one assistant message per line; every fifth is replayed later
    under another session."""
    k = F.col("k")
    events = table(spark, sf_dir, "events").withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("bigint"),
            "seconds": F.unix_seconds(F.col("ts").cast("timestamp")),
            "tokens": F.floor(F.col("value") * 100).cast("bigint"),
            "copy": F.lit(0),
        }
    )
    copies = events.filter(k % 5 == 0).withColumn("copy", F.lit(1))
    tokens = _number(F.col("tokens"))
    usage = _object(
        _pair(
            "input_tokens",
            F.when(k % 11 == 0, _text(tokens))
            .when(k % 11 == 1, F.concat(F.lit("-"), tokens))
            .when(k % 11 == 2, F.concat(tokens, F.lit(".75")))
            .otherwise(tokens),
        ),
        _pair("output_tokens", F.when(k % 9 != 0, _number(k * 3))),
        _pair("cache_creation_input_tokens", _number(k + 1)),
        _pair("cache_read_input_tokens", F.when(k % 6 != 0, _number(F.col("tokens") * 9))),
    )
    message = _object(
        _pair("id", _text(F.concat(F.lit("msg-"), F.col("event_id")))),
        _pair("model", F.when(k % 23 != 0, _text(event_model(k)))),
        _pair("content", F.concat(F.lit("["), _text(F.col("props")), F.lit("]"))),
        _pair("usage", F.when(k % 41 == 0, F.lit("null")).otherwise(usage)),
    )
    session = F.concat(F.when(F.col("copy") == 1, F.lit("resumed-")).otherwise(""), F.col("user_id"))
    line = _object(
        _pair("type", F.when(k % 29 == 0, _text(F.lit("user"))).otherwise(_text(F.lit("assistant")))),
        _pair("sessionId", _text(session)),
        _pair("requestId", F.when(k % 13 != 0, _text(F.concat(F.lit("req-"), F.col("event_id"))))),
        _pair(
            "timestamp",
            F.when(k % 17 == 0, _number(F.col("seconds") * 1000 + 250))
            .when(k % 19 == 0, _number(F.col("seconds")))
            .otherwise(_iso(F.col("seconds"))),
        ),
        _pair("cwd", F.when(k % 10 != 0, _text(F.concat(F.lit("/p/"), k % 10)))),
        _pair(
            "isSidechain",
            F.when(k % 7 == 0, F.lit("true")).when(k % 7 == 1, _text(F.lit("true"))),
        ),
        _pair("message", message),
    )
    lines = (
        events.unionByName(copies)
        .repartitionByRange("copy", "event_id")
        .sortWithinPartitions("copy", "event_id")
        .withColumn("whole", line)
        .withColumn(
            "value",
            F.when(k % 31 == 0, F.substring("whole", F.lit(1), F.length("whole") - 5)).otherwise(
                F.col("whole")
            ),
        )
    )
    root = scratch_path(spark, "message-logs")
    _write(lines, f"{root}/projects/-work-logs")
    return Source("claude_code", (f"{root}/projects",), TEXT_GLOB)


def write_great_count_logs(spark: SparkSession, sf_dir: str) -> Source:
    """``events`` as messages with counts of up to 2^53, and a quarter beyond what is exact."""
    n = F.col("event_id")
    great = (
        F.when(n % 4 == 0, F.lit(10_000_000_000_000) + n)
        .when(n % 4 == 1, F.lit(2**53))
        .when(n % 4 == 2, F.lit(2**53) + 2 * n + 2)
        .otherwise(n)
    )
    usage = _object(_pair("input_tokens", _number(great)), _pair("output_tokens", _number(n)))
    message = _object(
        _pair("id", _text(F.concat(F.lit("great-"), n))), _pair("model", _text(F.lit("gpt-5"))), _pair("usage", usage)
    )
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    line = _object(_pair("type", _text(F.lit("assistant"))), _pair("timestamp", _number(seconds)), _pair("message", message))
    root = scratch_path(spark, "great-logs")
    _write(table(spark, sf_dir, "events").select(line.alias("value")), f"{root}/projects/-great")
    return Source("claude_code", (f"{root}/projects",), TEXT_GLOB)


def write_running_total_logs(spark: SparkSession, sf_dir: str, kept: str = "true") -> Source:
    """``conversations`` as one file per conversation with running totals.

    User turns set the model, assistant turns report totals, system turns report a
    rate limit only. The session line is last in every second file. ``kept`` is a condition
    on ``conv_id`` and ``turn`` that leaves lines out; the session line has turn -1 or 1,000,000.
    """
    conversations = table(spark, sf_dir, "conversations")
    head_turn = F.when(F.col("conv_id") % 2 == 0, -1).otherwise(1_000_000).cast("bigint")
    heads = conversations.select("conv_id").distinct().withColumns({"turn": head_turn, "is_head": F.lit(True)})
    # Session lines join the others before the one shuffle by conversation. Spark leaves out a
    # shuffle of the union of two sides that lie by conversation already, but adaptive execution
    # coalesces each side for itself: a session line would come into a file of its own.
    lines = conversations.withColumn("is_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy("conv_id").orderBy("turn", "is_head")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spoken = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    turns = lines.withColumns(
        {
            "heard": F.sum(F.length("text")).over(so_far),
            "said": F.sum(spoken).over(so_far),
            "thought": F.count_if(~F.col("is_head")).over(so_far),
        }
    )
    stamp = _pair("timestamp", _iso(1_704_067_200 + F.col("conv_id") * 1000 + F.col("turn")))
    cached = F.floor(F.col("heard") / 3)
    totals = _object(
        _pair("input_tokens", _number(F.col("heard") + cached)),
        _pair("cached_input_tokens", _number(cached)),
        _pair("output_tokens", _number(F.col("said"))),
        _pair("reasoning_output_tokens", _number(F.col("thought"))),
    )
    model = (
        F.when(F.length("text") % 3 == 0, "gpt-5-codex")
        .when(F.length("text") % 3 == 1, "gpt-5-mini-2025")
        .otherwise("house-model-1")
    )
    text = _pair("message", _text(F.col("text")))
    usage = _object(
        _pair("type", _text(F.lit("token_count"))),
        _pair(
            "info",
            F.when(F.col("role") == "system", F.lit("null")).otherwise(
                _object(_pair("total_token_usage", totals))
            ),
        ),
        text,
    )
    is_user = F.col("role") == "user"
    entry = _object(
        stamp,
        _pair("type", F.when(is_user, _text(F.lit("turn_context"))).otherwise(_text(F.lit("event_msg")))),
        _pair("payload", F.when(is_user, _object(_pair("model", _text(model)), text)).otherwise(usage)),
    )
    truncated = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0)
    meta = _object(
        _pair("type", _text(F.lit("session_meta"))),
        _pair(
            "payload",
            _object(
                _pair("id", _text(F.concat(F.lit("conv-"), F.col("conv_id")))),
                _pair("cwd", _text(F.concat(F.lit("/w/"), F.col("conv_id") % 4))),
            ),
        ),
    )
    line = (
        F.when(F.col("is_head"), meta)
        .when(truncated, F.substring("whole", F.lit(1), F.length("whole") - 3))
        .otherwise(F.col("whole"))
    )
    root = scratch_path(spark, "total-logs")
    ordered = (
        turns.withColumn("whole", entry)
        .withColumn("value", line)
        .where(kept)
        .sortWithinPartitions("conv_id", "turn", "is_head")
    )
    _write_by_conversation(ordered, f"{root}/sessions")
    return Source("codex", (f"{root}/sessions",), TEXT_GLOB)


def write_entry_logs(spark: SparkSession, sf_dir: str) -> Source:
    """``documents`` as flat entries that carry the whole text."""
    n = F.col("doc_id")
    seconds = 1_700_000_000 + n * 60
    sec, milli = _number(seconds), _number(seconds * 1000 + 999)
    tokens = _object(
        _pair("input", _number(F.col("n_chars"))),
        _pair("output", _number(n % 100)),
        _pair("reasoning", F.when(n % 8 == 0, F.lit("true")).otherwise(_number(n % 7))),
        _pair(
            "cache",
            F.when(
                n % 9 != 0,
                _object(_pair("read", _number(n * 2)), _pair("write", _number(n % 13))),
            ),
        ),
    )
    line = _object(
        _pair("id", F.when(n % 4 != 0, _text(F.concat(F.lit("doc-"), n)))),
        _pair("sessionID", _text(F.concat_ws("-", "lang", "source"))),
        _pair("modelID", F.when(n % 3 == 0, _text(F.lit("gpt-5-mini")))),
        _pair("model", F.when(n % 3 <= 1, _text(F.lit("gpt-4o")))),
        _pair(
            "time",
            F.when(n % 6 == 0, _object(_pair("completed", milli), _pair("created", F.lit("1"))))
            .when(n % 6 == 1, _object(_pair("completed", F.lit("null")), _pair("created", sec)))
            .when(n % 6 == 2, sec)
            .when(n % 6 == 3, F.lit("null"))
            .when(n % 6 == 4, _object(_pair("created", milli))),
        ),
        _pair("timestamp", F.when(n % 6 == 3, _iso(seconds)).when(n % 6 == 5, milli)),
        _pair("text", _text(F.col("text"))),
        _pair("tokens", F.when(n % 10 == 0, F.lit("null")).otherwise(tokens)),
    )
    lines = (
        table(spark, sf_dir, "documents")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .select(
            F.when(n % 25 == 7, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("value")
        )
    )
    root = scratch_path(spark, "entry-logs")
    _write(lines, f"{root}/message/all")
    return Source("opencode", (root,), TEXT_GLOB)


def write_all_logs(spark: SparkSession, sf_dir: str) -> list[Source]:
    return [
        write_message_logs(spark, sf_dir),
        write_running_total_logs(spark, sf_dir),
        write_entry_logs(spark, sf_dir),
    ]


def overwrite_logs(spark: SparkSession, old: Source, new: Source) -> None:
    """Put the files of ``new`` in the place of those of ``old`` in the same folders, as a writer
    that goes on or rotates would leave them. Both have one file in a folder."""
    roots = old.roots[0], new.roots[0]
    if all(can_open(root) for root in roots):
        tasks = spark.sparkContext.defaultParallelism
        files = list_files(spark, [new]).select("uri").repartition(tasks)
        files.mapInArrow(partial(_replace, *roots), "n bigint").write.format("noop").mode("overwrite").save()
        return
    jvm = spark._jvm
    roots = [jvm.org.apache.hadoop.fs.Path(root) for root in roots]
    store = roots[0].getFileSystem(spark._jsc.hadoopConfiguration())
    places = {}
    for status in store.listStatus(roots[0]):
        if status.isDirectory():
            for own in store.listStatus(status.getPath()):
                places[status.getPath().getName()] = own.getPath()
    for status in store.listStatus(roots[1]):
        if status.isDirectory():
            for own in store.listStatus(status.getPath()):
                place = places.get(status.getPath().getName())
                if place is None:
                    place = jvm.org.apache.hadoop.fs.Path(roots[0], f"{status.getPath().getName()}/{own.getPath().getName()}")
                    store.mkdirs(place.getParent())
                else:
                    store.delete(place, False)
                store.rename(own.getPath(), place)


def _replace(old: str, new: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = open_store(old)
    base = open_store(new)[1]
    n = 0
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            path = open_store(uri)[1]
            folder, name = (root + path[len(base) :]).rsplit("/", 1)
            before = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            kept = [info.base_name for info in before if info.is_file and not info.base_name.startswith(".")]
            store.create_dir(folder)
            # The file keeps its name; a second attempt of the task finds it moved.
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.move(path, f"{folder}/{kept[0] if kept else name}")
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
