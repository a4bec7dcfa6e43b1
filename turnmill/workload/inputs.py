"""Inputs of the registered queries, made by Spark from the given tables.

Records are made row by row from ``documents``, so nothing is gathered under one
key: every text line of a document is one message.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.sources.ranges import file_system_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read as they are at every size."""
    return table(spark, sf_dir, "documents")


# Role spellings by doc_id % 4, for even and odd positions.
SPELLINGS = (("human", "ai"), ("user", "MODEL"), ("Human", "Assistant"), ("USER", "model"))
LONE_USER = 10  # doc_id % 10 = 9: the other side never answers
TOOL_CALLS = 3  # doc_id % 3 = 0: tool traffic is put in
FAULTS = 35  # doc_id % 35 = 0, 7, 14, 21, 28: one kind of fault each


def _spelled(position: Column) -> Column:
    doc = F.col("doc_id")
    own, other = F.lit(None), F.lit(None)
    for i, (user, assistant) in enumerate(SPELLINGS):
        own = F.when(doc % 4 == i, user).otherwise(own)
        other = F.when((doc % 4 == i) & (doc % LONE_USER != LONE_USER - 1), assistant).otherwise(
            F.when(doc % 4 == i, user).otherwise(other)
        )
    return F.when(position % 2 == 0, own).otherwise(other)


def _paragraphs() -> Column:
    return F.split("text", "\n")


def _json_text(value: Column) -> Column:
    """A JSON string literal."""
    return F.to_json(value.cast("variant"))


def _lines(docs: DataFrame, value: Column) -> DataFrame:
    return docs.select((F.col("doc_id") + 1).alias("lineno"), value.alias("value"))


def messages_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{"messages": [{role, content}, ...]} per document."""
    messages = F.transform(
        _paragraphs(),
        lambda p, i: F.struct(_spelled(i).alias("role"), p.alias("content")),
    )
    return _lines(
        documents(spark, sf_dir), F.to_json(F.struct(messages.alias("messages")))
    )


def openai_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with tool calls (null content) and tool rows in between."""
    call = F.struct(
        F.lit("function").alias("type"), F.struct(F.lit("lookup").alias("name")).alias("function")
    )

    def message(role: Column, content: Column, calls: Column) -> Column:
        return F.struct(
            role.alias("role"), content.alias("content"), calls.alias("tool_calls")
        )

    no_calls = F.lit(None).cast("array<struct<type:string,function:struct<name:string>>>")

    def per_paragraph(p: Column, i: Column) -> Column:
        plain = message(_spelled(i), p, no_calls)
        tools = F.array(
            message(F.lit("assistant"), F.lit(None).cast("string"), F.array(call)),
            message(F.lit("tool"), F.lit("found: 3 rows"), no_calls),
            plain,
        )
        return F.when(F.col("doc_id") % TOOL_CALLS == 0, tools).otherwise(F.array(plain))

    messages = F.flatten(F.transform(_paragraphs(), per_paragraph))
    return _lines(
        documents(spark, sf_dir),
        F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"}),
    )


def anthropic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First paragraph as top-level system (text, or a block for odd ids), the
    others as block lists with tool and thinking blocks in between."""
    def block(kind: str, text: Column, thinking: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"), thinking.alias("thinking")
        )

    none = F.lit(None).cast("string")

    def blocks(p: Column) -> Column:
        return F.array(
            block("thinking", none, F.lit("unseen")), block("text", p, none),
            block("tool_use", none, none),
        )

    first = F.get(_paragraphs(), F.lit(0))
    rest = F.slice(_paragraphs(), F.lit(2), F.size(_paragraphs()))
    messages = F.transform(
        rest, lambda p, i: F.struct(_spelled(i).alias("role"), blocks(p).alias("content"))
    )
    system = F.when(F.col("doc_id") % 2 == 0, _json_text(first)).otherwise(
        F.to_json(F.array(block("text", first, none)))
    )
    value = F.concat(
        F.lit('{"system":'), system, F.lit(',"messages":'), F.to_json(messages), F.lit("}")
    )
    return _lines(documents(spark, sf_dir), value)


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages lines, every seventh broken in one of five ways."""
    kind = (F.col("lineno") - 1) % FAULTS
    text = _json_text(F.col("value"))
    broken = (
        F.when(kind == 0, F.concat("value", F.lit("]")))
        .when(kind == 7, F.concat(F.lit("["), "value", F.lit("]")))
        .when(kind == 14, F.concat(F.lit('{"turns":[],"id":'), text, F.lit("}")))
        .when(kind == 21, F.concat(F.lit('{"messages":'), text, F.lit("}")))
        .when(kind == 28, F.concat(F.lit('{"messages":[{"role":"user"},7,'), text, F.lit("]}")))
        .otherwise(F.col("value"))
    )
    return messages_lines(spark, sf_dir).withColumn("value", broken)


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message object per row of ``conversations``."""
    role = F.when(F.col("conv_id") % 2 == 0, F.upper("role")).otherwise(
        F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    )
    value = F.to_json(F.struct(role.alias("role"), F.col("text").alias("content")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("value"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts and the assistant turns after them as samples;
    word lengths stand in for tokens."""
    turns = table(spark, sf_dir, "conversations")
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), lengths.alias("prompt")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", "turn", lengths.alias("sampled")
    )
    logprob = F.transform("sampled", lambda t: -(t.cast("double") + 1) / 8)
    sign = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, 1.0).otherwise(-1.0)
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"),
        "prompt",
        "sampled",
        logprob.alias("sampled_logprobs"),
        sign.alias("advantage"),
    )


def embedding_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datums from ``embeddings``: old log-probabilities are the reversed
    vector, the first vec_id % 8 positions are not trained on."""
    sign = F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-1.0)
    masked = (F.col("vec_id") % 8).cast("int")
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq_id"),
        F.reverse(vector).alias("logprobs"),
        F.transform(vector, lambda x, i: F.when(i < masked, 0.0).otherwise(sign)).alias(
            "advantages"
        ),
    )


def embedding_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass: the vector times 1 + vec_id % 20."""
    factor = (F.col("vec_id") % 20 + 1).cast("double")
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.transform(vector, lambda x: x * factor).alias("logprobs")
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step timings from ``events``: the path is the event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("path"),
        F.col("event_id").alias("step"),
        F.col("value").alias("seconds"),
    )


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric lines from ``events``: one run per event type; two of five events
    have the accuracy key."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double") / 128
    step = F.concat(F.lit('{"step":'), F.col("event_id").cast("string"))
    with_key = F.concat(step, F.lit(',"env/all/correct":'), k.cast("string"), F.lit("}"))
    without = F.concat(step, F.lit(',"optim/lr":0.1}'))
    return events.select(
        F.col("event_type").alias("run_id"),
        F.when(F.col("event_id") % 5 < 2, with_key).otherwise(without).alias("value"),
    )


def append_lines(lines: DataFrame, path: str, part: str) -> None:
    """As trainers do, add lines to ``path``/run/metrics.jsonl in the order of
    step, a run by one task: those of every step that 3 divides and an unfinished
    one (``part`` 'first'), or what the file still lacks."""
    _, folder = file_system_of(path)

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system_of(path)
        run, sink = None, None
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != run:
                    if sink:
                        sink.close()
                    store.create_dir(f"{folder}/{own}", recursive=True)
                    file = f"{folder}/{own}/metrics.jsonl"
                    sink = store.open_output_stream(file) if part == "first" else store.open_append_stream(file)
                    run = own
                sink.write(value.encode())
        if sink:
            sink.close()
        yield from ()

    # The first line of the rest is cut in two: its head is written at once.
    rest = F.col("step") % 3 != 0
    first = lines.where(rest).groupBy("run_id").agg(F.min("step").alias("step")).withColumn("cut", F.lit(True))
    line = F.concat("value", F.lit("\n"))
    marked = lines.join(first, ["run_id", "step"], "left")
    head, tail = F.substring(line, 1, 9), F.expr("substring(concat(value, '\n'), 10)")
    if part == "first":
        text = F.when(rest, F.when(F.col("cut"), head)).otherwise(line)
        place = F.col("cut").isNotNull()
    else:
        text = F.when(rest, F.when(F.col("cut"), tail).otherwise(line))
        place = F.col("cut").isNull()
    rows = marked.select("run_id", text.alias("text"), place.alias("place"), "step").where("text is not null")
    dealt = rows.repartition("run_id").sortWithinPartitions("run_id", "place", "step").select("run_id", "text")
    dealt.mapInArrow(appended, "done boolean").count()


def rollout_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command results from ``lineitem``: the order is the task."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    code = (
        F.when(q % 11 == 0, 124).when(q % 13 == 0, 126).when(q % 3 == 0, 1)
        .when(n % 4 == 3, 2).otherwise(0)
    )
    stderr = F.when(q % 2 == 0, "Error: No such container: x").otherwise("exit")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task"),
        (F.col("l_suppkey") % 4).alias("group"),
        code.alias("exit_code"),
        stderr.cast("binary").alias("stderr"),
    )
