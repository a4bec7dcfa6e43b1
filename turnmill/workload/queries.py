"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.errors import EmptyResultError, ImportFormatError
from turnmill.functions import chat, ratios
from turnmill.functions.text import is_blank
from turnmill.operators import metrics, rollouts, shaping, tasks, traces
from turnmill.plans.datasets import supervised_dataset
from turnmill.plans.import_traces import import_files
from turnmill.session import fresh_dir
from turnmill.sources.lines import scan_jsonl
from turnmill.sources.records import scan_bench_record, scan_metrics_jsonl, task_catalog
from turnmill.sources.sinks import stage_dataset, write_messages_jsonl
from turnmill.streaming.metrics import append_curve, metric_curve_stream
from turnmill.streaming.run import land
from turnmill.streaming.traces import import_stream, scan_jsonl_stream, start_import
from turnmill.workload import inputs
from turnmill.workload.inputs import table

TOKENS_PER_STEP = 7569
TEST_SIZE, SEED = 100, 7
RECORDS = 50
LIMIT = 60
RUN_FOLDER = r"run_id=([^/]+)/"


def _long(conversations: DataFrame) -> DataFrame:
    return traces.messages_long(conversations).withColumn("turn", F.col("turn").cast("bigint"))


# --- trace import ----------------------------------------------------------

def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of written files against the position at writing; every
    third document is preceded by a blank line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    blank_first = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(True))
    )
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    rows = docs.select("doc_id", "n", F.explode(blank_first).alias("filled"))
    record = F.to_json(F.struct("doc_id", "position", "n"))
    lines = rows.withColumn("position", place).select(
        F.when(F.col("filled"), record).otherwise("").alias("value")
    )
    path = fresh_dir(spark, "lines")
    lines.write.text(path)
    written = F.from_json("value", "doc_id bigint, position bigint, n bigint")
    return (
        scan_jsonl(spark, path, line_numbers=True)
        .where("value <> ''")
        .select("lineno", written.alias("w"))
        .select("w.doc_id", "w.n", (F.col("lineno") == F.col("w.position")).alias("exact"))
    )


def json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.expr(chat.json_record("value"))
    return inputs.faulty_lines(spark, sf_dir).select(
        "lineno", record.isNotNull().alias("is_json")
    )


def normalize_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("human", "AI", "Model", "tool", "function", "narrator", "SYSTEM")
    index = ((F.col("conv_id") + F.col("turn")) % (len(words) + 1)).cast("int")
    spelled = F.get(F.array(*[F.lit(w) for w in words], F.col("role")), index)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", spelled.alias("spelled")
    ).withColumn("normalized", F.expr(chat.normalize_role("spelled")))


def flatten_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as blocks: by position text, tool, bare text or blank text."""
    def block(p: Column, i: Column) -> Column:
        text = F.to_json(p.cast("variant"))
        return (
            F.when(i % 4 == 0, F.concat(F.lit('{"type":"text","text":'), text, F.lit("}")))
            .when(i % 4 == 1, F.concat(F.lit('{"type":"tool_use","text":'), text, F.lit("}")))
            .when(i % 4 == 2, text)
            .otherwise(F.lit('{"type":"text","text":" \\u2003\\n"}'))
        )

    blocks = F.array_join(F.transform(F.split("text", "\n"), block), ",")
    content = F.parse_json(F.concat(F.lit("["), blocks, F.lit("]")))
    return inputs.documents(spark, sf_dir).select("doc_id", content.alias("content")).select(
        "doc_id", F.expr(chat.flatten_content("content")).alias("flat")
    )


def blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.when(i % 3 == 1, F.lit("  \x1c\t")).when(i % 3 == 2, F.lit("")).otherwise(p),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(spaced).alias("i", "p")
    ).select("doc_id", F.col("i").cast("bigint").alias("i"), F.expr(is_blank("p")).alias("blank"))


def import_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(traces.import_conversations(inputs.messages_lines(spark, sf_dir), "messages"))


def import_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(traces.import_conversations(inputs.openai_lines(spark, sf_dir), "openai"))


def import_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(traces.import_conversations(inputs.anthropic_lines(spark, sf_dir), "anthropic"))


def import_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.import_turns(inputs.turn_lines(spark, sf_dir), ["conv_id"], 3)


def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.import_errors(inputs.faulty_lines(spark, sf_dir))


def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.first_error(import_errors(spark, sf_dir), ["lineno"])


def fail_loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that a failing import of files names, as it is there: its file's
    place among the files by path, its number and its error."""
    path = fresh_dir(spark, "faulty")
    inputs.faulty_lines(spark, sf_dir).orderBy("lineno").select("value").write.text(path)
    try:
        import_files(spark, path, fresh_dir(spark, "never"))
    except ImportFormatError as error:
        lines = scan_jsonl(spark, path, line_numbers=True)
        before = lines.where(F.col("file") < error.file).select("file").distinct().agg(F.count(F.lit(1)).alias("files_before"))
        named = lines.where((F.col("file") == error.file) & (F.col("lineno") == error.lineno))
        return traces.import_errors(named).select("lineno", "error_class", before.scalar().alias("files_before"))
    return spark.createDataFrame([], "lineno bigint, error_class string, files_before bigint")


def import_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import of files that stops at its limit, faulty lines left out."""
    folder = fresh_dir(spark, "limited")
    inputs.faulty_lines(spark, sf_dir).orderBy("lineno").select("value").write.text(f"{folder}/in")
    import_files(spark, f"{folder}/in", f"{folder}/out", limit=LIMIT, on_error="skip")
    kept = traces.import_conversations(spark.read.text(f"{folder}/out"))
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return kept.select(F.md5(F.array_join(said, "\n").cast("binary")).alias("digest"))


def require_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks match some texts; null where the error is raised."""
    rows = []
    for text in ("ring", "e", "no part is called so"):
        try:
            found = tasks.require_tasks(tasks.filter_tasks(_tasks(spark, sf_dir), text), "part", text)
        except EmptyResultError:
            found = None
        rows.append((text, found))
    return spark.createDataFrame(rows, "text string, n bigint")


def import_file_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file job around faulty lines, with its quarantine: what it wrote."""
    folder = fresh_dir(spark, "job")
    inputs.faulty_lines(spark, sf_dir).select("value").write.text(f"{folder}/in")
    done = import_files(spark, f"{folder}/in", f"{folder}/out", on_error="skip", quarantine=f"{folder}/bad")
    written, bad = (spark.read.text(f"{folder}/{x}").count() for x in ("out", "bad"))
    return spark.createDataFrame(
        [(done.conversations, written, done.skipped, bad)], "conversations bigint, written bigint, skipped bigint, put_aside bigint"
    )


def import_stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming import started twice on the same output: on half of the
    lines, then on the others in another folder; faulty lines are put aside."""
    folder = fresh_dir(spark, "restart")
    lines = inputs.faulty_lines(spark, sf_dir)
    for half in (0, 1):
        lines.where(F.col("lineno") % 2 == half).select("value").write.text(f"{folder}/in{half}")
        stream = scan_jsonl_stream(spark, f"{folder}/in{half}")
        start_import(stream, f"{folder}/out", quarantine=f"{folder}/bad", source=f"half{half}").awaitTermination()
    kept = spark.read.text(f"{folder}/out").select(F.lit("kept").alias("part"))
    bad = spark.read.json(f"{folder}/bad").select(F.lit("put aside").alias("part"))
    return kept.unionByName(bad).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def import_stream_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty lines of a streaming import by their places in the files."""
    folder = fresh_dir(spark, "places")
    inputs.faulty_lines(spark, sf_dir).select("value").write.text(f"{folder}/in")
    lines = scan_jsonl_stream(spark, f"{folder}/in", places=True)
    start_import(lines, f"{folder}/out", quarantine=f"{folder}/bad").awaitTermination()
    bad = spark.read.schema("file string, start bigint, error_class string").json(f"{folder}/bad")
    return bad.groupBy("error_class").agg(F.count_distinct("file", "start").alias("places"))


def import_around_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = traces.import_conversations(inputs.faulty_lines(spark, sf_dir), on_error="skip")
    return kept.select("lineno", F.size("messages").cast("bigint").alias("n_messages"))


def usable_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.messages_lines(spark, sf_dir)
    kept = traces.import_conversations(lines, min_messages=0)
    return traces.usable_conversations(kept, 4).select(
        "lineno", F.size("messages").cast("bigint").alias("n_messages")
    )


def limit_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.messages_lines(spark, sf_dir)
    kept = traces.import_conversations(lines, min_messages=4)
    return _long(traces.limit_conversations(kept, 10, ["lineno"]))


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {
        "messages": inputs.messages_lines,
        "openai": inputs.openai_lines,
        "anthropic": inputs.anthropic_lines,
    }
    parts = [
        traces.import_conversations(lines(spark, sf_dir), fmt).select(F.lit(fmt).alias("format"))
        for fmt, lines in made.items()
    ]
    return traces.import_summary(parts[0].unionAll(parts[1]).unionAll(parts[2]))


def write_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "messages")
    lines = inputs.anthropic_lines(spark, sf_dir)
    write_messages_jsonl(traces.import_conversations(lines, "anthropic"), path)
    return _long(traces.import_conversations(spark.read.text(path)))


def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    staged = stage_dataset(lines, fresh_dir(spark, "staged"))
    return staged.select(F.from_json("value", "doc_id bigint, text string").alias("d")).select("d.*")


def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "dump")
    inputs.openai_lines(spark, sf_dir).select("value").write.text(path)
    imported = import_stream(scan_jsonl_stream(spark, path), "openai")
    return _long(land(imported, fresh_dir(spark, "landed")).select("messages"))


# --- rollout batches -------------------------------------------------------

def _datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.assemble_datum(inputs.rollouts(spark, sf_dir))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = inputs.embedding_pass(spark, sf_dir).withColumnRenamed("logprobs", "new_logprobs")
    return rollouts.sequence_ratios(inputs.embedding_datums(spark, sf_dir).join(fresh, "seq_id"))


def _positions(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows."""
    zipped = F.arrays_zip(*arrays)
    return df.select("seq_id", F.posexplode(zipped).alias("pos", "p")).select(
        "seq_id", F.col("pos").cast("bigint").alias("pos"), "p.*"
    )


def assemble_datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(
        _datums(spark, sf_dir), "model_input", "target_tokens", "logprobs", "advantages"
    )


def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = rollouts.loss_mask(inputs.embedding_datums(spark, sf_dir))
    return masked.select(
        "seq_id",
        F.col("n_trained").cast("bigint").alias("n_trained"),
        F.array_position("mask", True).cast("bigint").alias("first_trained"),
    )


def rollout_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_batch = _datums(spark, sf_dir).withColumn("batch", F.col("seq_id") % 16)
    stats = rollouts.rollout_batch_stats(by_batch, ["batch"])
    return stats.withColumn("mean_length", F.round("mean_length", 6))


def sequence_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("seq_id", F.round("log_ratio", 6).alias("log_ratio"))


def token_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = inputs.embedding_pass(spark, sf_dir).withColumnRenamed("logprobs", "new_logprob")
    tokens = _positions(
        inputs.embedding_datums(spark, sf_dir).join(fresh, "seq_id"),
        "new_logprob", "logprobs", "advantages",
    ).withColumnsRenamed({"logprobs": "logprob", "advantages": "advantage"})
    by_sequence = rollouts.token_log_ratio(tokens, ["seq_id"])
    return by_sequence.select("seq_id", F.round("log_ratio", 6).alias("log_ratio"))


def sequence_importance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("seq_id", F.round("ratio", 6).alias("ratio"))


def clip_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    narrow = ratios.clip_gate(F.col("ratio"), 0.95, 1.05)
    return rated.select("seq_id", "inside", narrow.alias("inside_narrow"))


def reweight_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = ratios.reweight_advantages(F.col("advantages"), F.col("weight"))
    rows = _positions(_rated(spark, sf_dir).withColumn("advantages", weighted), "advantages")
    return rows.select("seq_id", "pos", F.round("advantages", 6).alias("advantage"))


def swap_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = rollouts.swap_logprobs(
        inputs.embedding_datums(spark, sf_dir), inputs.embedding_pass(spark, sf_dir)
    )
    rows = _positions(swapped, "logprobs", "advantages")
    return rows.select(
        "seq_id", "pos", F.round("logprobs", 6).alias("logprob"),
        F.col("advantages").alias("advantage"),
    )


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rollouts.second_pass(
        inputs.embedding_datums(spark, sf_dir), inputs.embedding_pass(spark, sf_dir)
    )
    total = F.aggregate("advantages", F.lit(0.0), lambda s, a: s + a)
    return done.select(
        "seq_id", "inside", F.round("weight", 6).alias("weight"),
        F.round(total, 4).alias("total_advantage"),
        F.round(F.element_at("logprobs", 1), 6).alias("first_logprob"),
    )


def clip_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir).withColumn("batch", F.col("seq_id") % 16)
    shares = rollouts.clip_fraction(rated, ["batch"])
    return shares.withColumn("clip_fraction", F.round("clip_fraction", 6))


# --- dataset shaping -------------------------------------------------------

def _digested(conversations: DataFrame, *more: str) -> DataFrame:
    """lineno, a digest of all messages and the columns ``more``."""
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return conversations.select("lineno", F.md5(F.array_join(said, "\n").cast("binary")).alias("digest"), *more)


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    imported = traces.import_conversations(inputs.messages_lines(spark, sf_dir))
    return _digested(shaping.holdout_split(imported, ["lineno"], TEST_SIZE, SEED), "split")


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    imported = traces.import_conversations(inputs.messages_lines(spark, sf_dir))
    return _digested(shaping.batch_plan(imported, ["lineno"], 8, SEED), "rank", "batch")


def supervised_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shaping of a supervised run end to end: import, hold out, batch."""
    imported = traces.import_conversations(inputs.openai_lines(spark, sf_dir), "openai")
    train, test = supervised_dataset(imported, ["lineno"], TEST_SIZE, 8, SEED)
    held_out = test.withColumns({"rank": F.lit(None).cast("bigint"), "batch": F.lit(None).cast("bigint")})
    return _digested(train.unionByName(held_out), "rank", "batch")


def training_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.training_schedule(table(spark, sf_dir, "documents"), 8, epochs=3, save_every=20, eval_every=7)


def rollout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    plan = shaping.rollout_plan(prompts, ["conv_id", "turn"], batch_size=64, group_size=8, seed=SEED)
    return plan.withColumn("member", F.col("member").cast("bigint"))


def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    datums = _datums(spark, sf_dir)
    arrays = ["model_input", "target_tokens", "logprobs", "advantages"]
    return _positions(shaping.truncate_tokens(datums, arrays, 16), *arrays)


# --- agent tasks and rollout logs ------------------------------------------

def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("task_name"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a task per part, in three datasets with equal task names; every
    fifth part has no task.toml, and each has an instruction that is not its own."""
    def file(name: str, text: Column) -> Column:
        folder = F.concat(F.lit("/tasks/set"), F.col("p_partkey") % 3, F.lit("/t"), F.expr("p_partkey DIV 3"))
        path = F.concat(folder, F.lit(f"/{name}"))
        return F.struct(path.alias("path"), text.alias("content"))

    files = F.array(
        file("instruction.md", F.col("p_name")),
        file("tests/test.sh", F.col("p_brand")),
        file("environment/Dockerfile", F.col("p_type")),
        file("notes.txt", F.lit("unread")),
        file("solution/instruction.md", F.lit("of the solution")),
        F.when(F.col("p_partkey") % 5 != 0, file("task.toml", F.col("p_size").cast("string"))),
    )
    rows = table(spark, sf_dir, "part").select(F.explode(files).alias("f")).where("f IS NOT NULL")
    return task_catalog(rows.select("f.*"))


def filter_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.filter_tasks(_tasks(spark, sf_dir), "ring")


def limit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.limit_tasks(filter_tasks(spark, sf_dir), 25, ["task_name", "p_partkey"])


def limit_tasks_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by name alone, ten names to all of them: exactly as many as asked."""
    named = _tasks(spark, sf_dir).select(F.concat(F.lit("t"), F.col("p_partkey") % 10).alias("task_name"))
    return tasks.limit_tasks(named, 25).groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))


def limit_tasks_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.limit_tasks(_tasks(spark, sf_dir), 1500, ["task_name", "p_partkey"])


def truncate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_binary("text", F.lit("utf-8")).alias("stdout")
    )
    return tasks.truncate_outputs(logs, ["stdout"], 100)


def command_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tasks.label_outcomes(inputs.rollout_logs(spark, sf_dir))
    return labelled.groupBy("exit_code", "outcome").agg(F.count(F.lit(1)).alias("n"))


def verdict_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tasks.label_outcomes(inputs.rollout_logs(spark, sf_dir))
    rewards = tasks.reward_summary(labelled, ["task", "group"])
    return rewards.withColumn("pass_rate", F.round("pass_rate", 6))


# --- metrics ---------------------------------------------------------------

def step_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.step_timing_summary(inputs.timings(spark, sf_dir), TOKENS_PER_STEP)
    raw = ("mean_raw", "stdev_raw", "tokens_per_s_raw")
    return summary.withColumns({c: F.round(c, 6) for c in raw})


def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.step_times(metrics.mark_warmup(inputs.timings(spark, sf_dir)))


def path_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.step_timing_summary(inputs.timings(spark, sf_dir), TOKENS_PER_STEP)
    return metrics.path_comparison(summary, "view", "click")


def _record_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of RECORDS benchmark runs: views are the fused path, all other
    events the other one."""
    events = table(spark, sf_dir, "events")
    fused = F.coalesce(F.col("event_type") == "view", F.lit(False))
    return events.select(
        (F.col("user_id") % RECORDS).alias("record_id"),
        F.when(fused, metrics.FUSED).otherwise(metrics.TWO_PASS).alias("path"),
        F.col("event_id").alias("step"),
        F.col("value").alias("seconds"),
    )


def bench_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as pretty JSON, one file each, read and made tidy."""
    by = ["record_id", "path"]
    summary = metrics.step_timing_summary(_record_timings(spark, sf_dir), TOKENS_PER_STEP, by)
    exact = {"mean_s": "mean_raw", "stdev_s": "stdev_raw", "tokens_per_s": "tokens_per_s_raw"}
    records = metrics.bench_record(
        summary.withColumns({name: F.round(raw, 6) for name, raw in exact.items()}), by=["record_id"]
    )
    path = fresh_dir(spark, "records")
    metrics.write_bench_records(records, path, ["record_id"])
    read = scan_bench_record(spark, f"{path}/*")
    record_id = F.regexp_extract("file", r"record_id=(\d+)/", 1).cast("bigint")
    tidy = metrics.bench_tidy(read.withColumn("record_id", record_id).drop("file"))
    return tidy.select(
        "record_id", "metric", "better", F.col("position").cast("bigint").alias("position"),
        "path", "value",
    )


def _metric_files(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_dir(spark, "runs")
    inputs.metric_lines(spark, sf_dir).write.partitionBy("run_id").text(path)
    return path


def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all runs, with or without the accuracy key."""
    rows = scan_metrics_jsonl(spark, f"{_metric_files(spark, sf_dir)}/*", RUN_FOLDER)
    return rows.select(
        "run_id",
        F.variant_get("row", "$.step", "bigint").alias("step"),
        F.variant_get("row", "$['optim/lr']", "double").alias("lr"),
    )


def metric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_metrics_jsonl(spark, f"{_metric_files(spark, sf_dir)}/*", RUN_FOLDER)
    return metrics.metric_curve(rows).select("run_id", "step", "value")


def stream_metric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_metric_files(spark, sf_dir)}/*"
    curve = metric_curve_stream(spark, path, run_pattern=RUN_FOLDER)
    return land(curve, fresh_dir(spark, "curve"))


def growing_metric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per run, which grows between two triggers: a third of its lines
    with the beginning of the next one, then the rest."""
    path, out = fresh_dir(spark, "growing"), fresh_dir(spark, "curve")
    lines = inputs.metric_lines(spark, sf_dir).withColumn("step", F.get_json_object("value", "$.step").cast("long"))
    for half in ("first", "then"):
        inputs.append_lines(lines, path, half)
        curve = append_curve(spark, f"{path}/*/metrics.jsonl", out)
    return curve.select("run_id", "step", "value")


QUERIES = {
    "scan_jsonl": scan_lines,
    "json_record": json_record,
    "normalize_role": normalize_role,
    "flatten_content": flatten_content,
    "is_blank": blank_text,
    "import_messages": import_messages,
    "import_openai": import_openai,
    "import_anthropic": import_anthropic,
    "import_turns": import_turns,
    "import_errors": import_errors,
    "first_error": first_error,
    "fail_loud": fail_loud,
    "import_file_job": import_file_job,
    "import_limit": import_limit,
    "import_stream_restart": import_stream_restart,
    "import_stream_faults": import_stream_faults,
    "import_skip_errors": import_around_faults,
    "usable_conversations": usable_conversations,
    "limit_conversations": limit_conversations,
    "import_summary": import_summary,
    "write_messages_jsonl": write_messages,
    "stage_dataset": stage_lines,
    "import_stream": stream_import,
    "assemble_datum": assemble_datum,
    "loss_mask": loss_mask,
    "rollout_batch_stats": rollout_batch_stats,
    "sequence_log_ratio": sequence_log_ratio,
    "token_log_ratio": token_log_ratio,
    "sequence_importance_ratio": sequence_importance_ratio,
    "clip_gate": clip_gate,
    "reweight_advantages": reweight_advantages,
    "swap_logprobs": swap_logprobs,
    "second_pass": second_pass,
    "clip_fraction": clip_fraction,
    "holdout_split": holdout_split,
    "batch_plan": batch_plan,
    "supervised_dataset": supervised_data,
    "training_schedule": training_schedule,
    "rollout_plan": rollout_plan,
    "truncate_tokens": truncate_tokens,
    "task_catalog": catalog,
    "filter_tasks": filter_tasks,
    "require_tasks": require_tasks,
    "limit_tasks": limit_tasks,
    "limit_tasks_ties": limit_tasks_ties,
    "limit_tasks_large": limit_tasks_large,
    "truncate_output": truncate_output,
    "command_outcome": command_outcome,
    "verdict_reward": verdict_reward,
    "step_timing_summary": step_timing_summary,
    "step_times": step_times,
    "path_comparison": path_comparison,
    "bench_tidy": bench_records,
    "scan_metrics_jsonl": scan_metrics,
    "metric_curve": metric_curve,
    "metric_curve_stream": stream_metric_curve,
    "metric_curve_growing": growing_metric_curve,
}
