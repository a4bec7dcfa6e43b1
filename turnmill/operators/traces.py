"""Chat-trace import: dump lines in, clean conversations out.

Everything here works on any DataFrame with a text column of lines; all other
columns (file, line number, ids) travel along. The work on one line is one
projection with one JSON parse, followed by a generator that emits the row or
not. A plain filter would be pushed below the projection and repeat the parse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from turnmill.errors import EmptyResultError, ImportFormatError
from turnmill.functions import chat
from turnmill.functions.text import is_visible
from turnmill.operators.ranks import first_rows
from turnmill.session import prepare


@dataclass(frozen=True)
class DumpFormat:
    """How a record becomes messages: (top-level system, raw messages) ->
    messages, as SQL text. ``plain`` formats hold nothing but messages, mostly
    plain text; their lines are first tried with the cheaper parse for that."""

    parse: Callable[[str, str], str]
    plain: bool = False


# A new dump format is one more entry.
PARSERS = {
    "messages": DumpFormat(lambda system, raw: chat.normalize_messages(raw), plain=True),
    "openai": DumpFormat(lambda system, raw: chat.normalize_messages(raw), plain=True),
    "anthropic": DumpFormat(
        lambda system, raw: f"concat({chat.system_message(system)}, {chat.normalize_messages(raw)})"
    ),
}


def parser_for(fmt: str) -> DumpFormat:
    if fmt not in PARSERS:
        raise ImportFormatError("unknown_format", f"{fmt!r}; known: {', '.join(PARSERS)}")
    return PARSERS[fmt]


def _result(messages: str, error_class: str, detail: str) -> str:
    return (
        f"named_struct('messages', {messages}, 'error_class', {error_class}, 'detail', {detail})"
    )


def _checked(line: str, fmt: str) -> str:
    """struct(messages, error_class, detail) of a line. A line of the expected
    shape takes one typed parse; the others are parsed again for a closer look."""
    dump = parser_for(fmt)
    none = "CAST(NULL AS STRING)"
    sound = (
        f"is_valid_utf8({line}) AND _typed.messages IS NOT NULL "
        "AND forall(_typed.messages, _x -> _x IS NOT NULL)"
    )
    messages = dump.parse("_typed.system", "_typed.messages")
    judged = (
        f"CASE WHEN {sound} THEN {_result(messages, none, none)} "
        f"ELSE {_closer_look(line, dump.parse)} END"
    )
    typed = chat.bound(chat.typed_record(line), "_typed", judged)
    if not dump.plain:
        return typed
    found = f"CASE WHEN _plain IS NOT NULL THEN {_result('_plain', none, none)} ELSE {typed} END"
    return chat.bound(chat.plain_messages(line), "_plain", found)


def _closer_look(line: str, parse: Callable[[str, str], str]) -> str:
    """The same result by way of an untyped parse; the first failing check names
    the error."""
    stray = f"filter(_list, _s -> NOT {chat.is_object('_s', 'role')})"
    error = (
        f"CASE WHEN NOT is_valid_utf8({line}) THEN 'invalid_utf8' "
        f"WHEN _record IS NULL AND octet_length({line}) >= {chat.MAX_RECORD_BYTES} "
        "THEN 'record_too_large' "
        "WHEN _record IS NULL THEN 'invalid_json' "
        f"WHEN _list IS NOT NULL THEN CASE WHEN size({stray}) > 0 THEN 'message_not_object' END "
        f"WHEN NOT {chat.is_object('_record', 'messages')} THEN 'not_object' "
        f"WHEN {chat.part('_record', '$.messages')} IS NULL THEN 'missing_messages' "
        "ELSE 'messages_not_list' END"
    )
    keys = f"map_keys({chat.part('_record', '$', 'map<string,variant>')})"
    detail = (
        f"CASE _error WHEN 'missing_messages' THEN to_json(sort_array({keys})) "
        f"WHEN 'message_not_object' THEN to_json(get({stray}, 0)) END"
    )
    messages = parse(chat.part("_record", "$.system"), chat.raw_messages("_list"))
    result = _result(f"CASE WHEN _error IS NULL THEN {messages} END", "_error", detail)
    return chat.bound(
        chat.json_record(line),
        "_record",
        chat.bound(
            chat.part("_record", "$.messages", "array<variant>"),
            "_list",
            chat.bound(error, "_error", result),
        ),
    )


def _emit(
    lines: DataFrame, fmt: str, keep: str, fields: Sequence[str], value: str
) -> DataFrame:
    """Generate ``fields`` of the results ``_c`` of the lines for which ``keep``
    holds."""
    prepare(lines.sparkSession)
    others = [c for c in lines.columns if c != value]
    line = f"`{value}`"
    picked = ", ".join(f"'{name}', _c.{name}" for name in fields)
    kept = f"filter(array({_checked(line, fmt)}), _c -> {keep})"
    result = F.expr(f"inline(transform({kept}, _c -> named_struct({picked})))")
    return lines.where(is_visible(line)).select(*others, result)


def parse_lines(lines: DataFrame, fmt: str, min_messages: int = 2, value: str = "value") -> DataFrame:
    """Usable conversations and faulty lines in one pass: messages, or else
    error_class and detail, are set."""
    keep = f"_c.error_class IS NOT NULL OR {chat.is_usable('_c.messages', min_messages)}"
    return _emit(lines, fmt, keep, ["messages", "error_class", "detail"], value)


def import_conversations(
    lines: DataFrame,
    fmt: str = "messages",
    min_messages: int = 2,
    on_error: str = "fail",
    value: str = "value",
) -> DataFrame:
    """Usable conversations of ``lines``: their other columns and ``messages``.

    ``on_error='fail'`` makes the job fail on a faulty line; ``'skip'`` leaves
    such lines to ``import_errors``.
    """
    _check_mode(on_error)
    usable = chat.is_usable("_c.messages", min_messages)
    if on_error == "skip":
        keep = f"_c.error_class IS NULL AND {usable}"
    else:
        place = "' at line ', lineno, " if "lineno" in lines.columns else ""
        text = f"concat_ws('', 'import format error', {place}': ', _c.error_class, ' ', _c.detail)"
        keep = (
            f"CASE WHEN _c.error_class IS NOT NULL THEN CAST(raise_error({text}) AS BOOLEAN) "
            f"ELSE {usable} END"
        )
    return _emit(lines, fmt, keep, ["messages"], value)


def _check_mode(on_error: str) -> None:
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}")


def import_errors(lines: DataFrame, fmt: str = "messages", value: str = "value") -> DataFrame:
    """Faulty lines: their other columns, ``error_class`` and ``detail``."""
    return _emit(lines, fmt, "_c.error_class IS NOT NULL", ["error_class", "detail"], value)


def first_error(errors: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The earliest faulty line in ``order_by`` as one row, or no row."""
    earliest = F.min(F.struct(*order_by, "error_class", "detail")).alias("_first")
    return errors.agg(earliest).where("_first IS NOT NULL").select("_first.*")


def fail_loud(errors: DataFrame, order_by: Sequence[str]) -> None:
    """Raise on the earliest faulty line, if any."""
    row = first_error(errors, order_by).first()
    if row is not None:
        found = row.asDict()
        raise ImportFormatError(
            found["error_class"], found["detail"], found.get("file"), found.get("lineno")
        )


def usable_conversations(conversations: DataFrame, min_messages: int = 2) -> DataFrame:
    """The same test for conversations that are already normalised."""
    return conversations.where(chat.is_usable("messages", min_messages))


def limit_conversations(conversations: DataFrame, limit: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``limit`` conversations in input order. The limit is checked
    after a conversation is kept, so anything below one still gives one."""
    return first_rows(conversations, max(limit, 1), order_by)


def import_summary(conversations: DataFrame, by: str = "format") -> DataFrame:
    """Number of conversations by dump format."""
    return conversations.groupBy(by).agg(F.count(F.lit(1)).alias("conversations"))


def require_conversations(written: int, min_messages: int = 2) -> int:
    if written == 0:
        raise EmptyResultError(
            "every chat was dropped: none has an assistant turn and "
            f"min_messages={min_messages} or more; is it another format?"
        )
    return written


def messages_long(conversations: DataFrame, turn: str = "turn") -> DataFrame:
    """One row per message: the other columns, turn, role, text."""
    others = [c for c in conversations.columns if c != "messages"]
    return conversations.select(*others, F.posexplode("messages").alias(turn, "_m")).select(
        *others, turn, F.col("_m.role").alias("role"), F.col("_m.content").alias("text")
    )


def import_turns(
    turns: DataFrame,
    conversation: Sequence[str],
    min_messages: int = 2,
    on_error: str = "fail",
    value: str = "value",
) -> DataFrame:
    """The import for dumps with one message object per row.

    Messages are normalised where they are; only counts per conversation are
    shuffled and aggregated, never the messages of one conversation collected,
    so a conversation may hold any share of the rows.
    """
    _check_mode(on_error)
    prepare(turns.sparkSession)
    others = [c for c in turns.columns if c != value]
    line = f"`{value}`"
    text = f"concat('import format error: not a message object: ', {line})"
    fault = f"CAST(raise_error({text}) AS BOOLEAN)" if on_error == "fail" else "FALSE"
    message = f"array(CASE WHEN _raw IS NOT NULL THEN {chat.message_of('_raw')} END)"
    keep = f"CASE WHEN _m IS NULL THEN {fault} ELSE {chat.is_kept('_m')} END"
    result = chat.bound(chat.typed_message(line), "_raw", f"filter({message}, _m -> {keep})")
    kept = turns.where(is_visible(line)).select(*others, F.expr(f"inline({result})"))
    usable = (
        kept.groupBy(*conversation)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.col("role") == "assistant").alias("_has_assistant"),
        )
        .where((F.col("_n") >= min_messages) & F.col("_has_assistant"))
    )
    return kept.join(usable, [*conversation], "left_semi").withColumnRenamed("content", "text")
