"""Chat records, as SQL text over VARIANT and typed values.

``content`` and ``system`` are unions (text, list of blocks, anything else), so
they stay VARIANT until the type of each part has been looked at. Within lambdas
nothing is shared between expressions; ``bound`` names a value that is used more
than once, so that it is computed once per row.
"""

from __future__ import annotations

from turnmill.functions.text import is_visible, stripped

# Role spellings and what they stand for. Any other role (tool,
# function, tool_result, unknown words, non-text) is not conversation.
ROLE_SPELLINGS = {
    "user": ("human", "user"),
    "assistant": ("ai", "model", "assistant"),
    "system": ("system",),
}
TEXT_BLOCK = "text"

# Typed forms of a line. Role is text: a role of any other type turns into text
# that is no known spelling, and is dropped as it should be.
_MARKED_TEXTS = "array<struct<messages:array<struct<role:string,content:string>>,mark:string>>"
_MARKED_RECORD = (
    "array<struct<messages:array<struct<role:string,content:variant>>,"
    "system:variant,mark:string>>"
)
_MARKED_MESSAGE = "array<struct<role:string,content:variant,mark:string>>"

# Texts that something other than text could have turned into when read as text,
# and the characters they start with.
_UNLIKE_TEXT = r'(?s)^(?:\[.*\]|\{.*\}|-?[0-9][0-9.eE+-]*|true|false|"?(?:NaN|[+-]?Infinity)"?)$'
_UNLIKE_STARTS = '"[{-+0123456789tfNI'

# Most of a record's bytes a VARIANT can hold.
MAX_RECORD_BYTES = 128 * 1024 * 1024

# Plain JSON, with no limit on the length of texts and numbers.
_PLAIN_JSON = {
    "allowNonNumericNumbers": "false",
    "allowSingleQuotes": "false",
    "maxStringLen": "2147483647",
    "maxNumLen": "2147483647",
}
_WITH_NAN = {**_PLAIN_JSON, "allowNonNumericNumbers": "true"}


def bound(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, evaluated once: the
    finish step of an aggregate over no rows, whose start is ``value``. Unlike an
    element of a transformed one-row array, it copies nothing."""
    return f"aggregate(array(), {value}, (_a, _e) -> _a, {name} -> {body})"


def part(value: str, path: str, as_type: str = "variant") -> str:
    return f"try_variant_get({value}, '{path}', '{as_type}')"


def is_text(value: str) -> str:
    return f"schema_of_variant({value}) = 'STRING'"


def text_of(value: str) -> str:
    """The text of a VARIANT that is text, NULL for any other type (a plain
    cast would also turn numbers and objects into text)."""
    return f"CASE WHEN {is_text(value)} THEN {part(value, '$', 'string')} END"


def is_object(value: str, usual_key: str) -> str:
    """Is the VARIANT an object? One that has ``usual_key`` is; the full type
    text, which walks the whole value, is only made for the others."""
    return (
        f"({part(value, f'$.{usual_key}')} IS NOT NULL "
        f"OR startswith(schema_of_variant({value}), 'OBJECT'))"
    )


def normalize_role(role: str) -> str:
    """user, assistant, system or NULL (drop), for a text."""
    cases = " ".join(
        f"WHEN '{spelling}' THEN '{name}'"
        for name, spellings in ROLE_SPELLINGS.items()
        for spelling in spellings
    )
    return f"CASE lower({role}) {cases} END"


def _block_text(block: str) -> str:
    """Text of one content block. The type comes first, as a tool block may be
    large; only the text "text" can turn into that text."""
    text = part(block, "$.text")
    body = (
        f"CASE WHEN _kind = '{TEXT_BLOCK}' AND {is_text(text)} "
        f"THEN {part(block, '$.text', 'string')} "
        f"WHEN _kind IS NULL THEN {text_of(block)} END"
    )
    return bound(part(block, "$.type", "string"), "_kind", body)


def flatten_content(content: str) -> str:
    """Text of a VARIANT content: text as it is; of a list the non-blank texts,
    joined by line ends; empty for anything else.

    A list of objects only is read in one go; lists with bare texts in them are
    looked at block by block.
    """
    def joined(texts: str) -> str:
        return f"array_join(filter({texts}, _t -> {is_visible('_t')}), '\\n')"

    of_object = f"CASE WHEN _b.type = '{TEXT_BLOCK}' THEN {text_of('_b.text')} END"
    mixed = bound(
        part(content, "$", "array<variant>"),
        "_items",
        joined(f"transform(_items, _i -> {_block_text('_i')})"),
    )
    body = (
        f"CASE WHEN _blocks IS NULL THEN coalesce({text_of(content)}, '') "
        f"WHEN exists(_blocks, _b -> _b IS NULL) THEN {mixed} "
        f"ELSE {joined(f'transform(_blocks, _b -> {of_object})')} END"
    )
    return bound(part(content, "$", "array<struct<type:string,text:variant>>"), "_blocks", body)


def message_of(raw: str) -> str:
    """struct(role, content) of a raw message; either part may be NULL, which
    means drop. Content is not looked at when the role is dropped."""
    content = flatten_content(f"{raw}.content")
    body = (
        f"named_struct('role', _role, 'content', CASE WHEN _role IS NOT NULL THEN {content} END)"
    )
    return bound(normalize_role(f"{raw}.role"), "_role", body)


def is_kept(message: str) -> str:
    return f"({message}.role IS NOT NULL AND {is_visible(f'{message}.content')})"


def normalize_messages(raw: str) -> str:
    """array<struct<role, content>> of raw messages, order kept."""
    return f"filter(transform({raw}, _r -> {message_of('_r')}), _m -> {is_kept('_m')})"


def system_message(system: str) -> str:
    """Zero or one system message from a record's top-level ``system``."""
    message = f"named_struct('role', 'system', 'content', {flatten_content(system)})"
    return f"filter(array({message}), _m -> {is_kept('_m')})"


def is_usable(messages: str, min_messages: int = 2) -> str:
    """Long enough, and with something to train on."""
    return (
        f"(size({messages}) >= {int(min_messages)} "
        f"AND exists({messages}, _u -> _u.role = 'assistant'))"
    )


def _mark(line: str) -> str:
    return f"hex(xxhash64({line}))"


def _marked(line: str, before: str, after: str, as_type: str, options: dict[str, str]) -> str:
    """The line parsed as the first of two array elements, the second being the
    line's own hash.

    ``from_json`` overlooks text after a document. A line that closes the array
    early or adds elements to it cannot also carry its own hash in the right
    place, so one parse tells whether the line is exactly one document.
    """
    whole = f"startswith({line}, '{{') AND endswith({line}, '}}')"
    body = f"CASE WHEN {whole} THEN {line} ELSE {stripped(line)} END"
    settings = ", ".join(f"'{k}', '{v}'" for k, v in options.items())
    pair = f"concat('[', {body}, '{before}', {_mark(line)}, '{after}')"
    return f"from_json({pair}, '{as_type}', map({settings}))"


def _has_odd_infinity(line: str) -> str:
    """Signed infinities other than -Infinity are the parser's own. They are
    looked for outside of JSON strings, in the rare line that has the letters."""
    no_escapes = rf"regexp_replace({line}, r'(?s)\\.', '')"
    outside = f"""regexp_replace({no_escapes}, r'"[^"]*+"', '')"""
    return (
        f"((contains({line}, 'INF') OR contains({line}, '+Infinity')) "
        rf"AND {outside} RLIKE r'[+-]INF|\+Infinity')"
    )


def json_record(line: str) -> str:
    """The VARIANT of one JSON document, NULL when the line is not exactly one."""
    pair = _marked(line, ',"', '"]', "variant", _WITH_NAN)
    sole = (
        f"CASE WHEN size(_pair) = 2 AND {part('_pair[1]', '$', 'string')} = {_mark(line)} "
        "THEN _pair[0] END"
    )
    found = bound(part(pair, "$", "array<variant>"), "_pair", sole)
    return f"CASE WHEN NOT {_has_odd_infinity(line)} THEN {found} END"


def _may_repeat(line: str) -> str:
    """Whether the key ``messages`` may occur again, also spelled with escapes. A
    typed read keeps the first value where the last has another type; the last
    one counts."""
    again = f"locate('\"messages\"', {line}, locate('\"messages\"', {line}) + 1) > 0"
    return f"({again} OR (contains({line}, r'\\u00') AND {line} RLIKE r'\\\\u00[67]'))"


def _typed(line: str, as_type: str) -> str:
    pair = _marked(line, ',{"mark":"', '"}]', as_type, _PLAIN_JSON)
    once = f"NOT {_may_repeat(line)}"
    sole = f"CASE WHEN size(_pair) = 2 AND _pair[1].mark = {_mark(line)} AND {once} THEN _pair[0] END"
    return bound(pair, "_pair", sole)


def plain_messages(line: str) -> str:
    """Normalised messages of a sound line all of whose contents are text. NULL
    for any other line, and where text cannot be told from the text form of a
    number, list or object."""
    spellings = ", ".join(f"'{s}'" for words in ROLE_SPELLINGS.values() for s in words)
    starts = ", ".join(str(ord(c)) for c in _UNLIKE_STARTS)
    wanted = f"_r IS NULL OR (lower(_r.role) IN ({spellings}) AND {is_visible('_r.content')})"
    doubtful = (
        f"_k IS NULL OR (ascii(_k.content) IN ({starts}) "
        f"AND _k.content RLIKE r'{_UNLIKE_TEXT}')"
    )
    plain = f"named_struct('role', {normalize_role('_k.role')}, 'content', _k.content)"
    kept = bound(
        f"{_typed(line, _MARKED_TEXTS)}.messages",
        "_raw",
        f"CASE WHEN is_valid_utf8({line}) THEN filter(_raw, _r -> {wanted}) END",
    )
    body = f"CASE WHEN NOT exists(_kept, _k -> {doubtful}) THEN transform(_kept, _k -> {plain}) END"
    return bound(kept, "_kept", body)


def typed_record(line: str) -> str:
    """struct(messages, system) of a sound line, read straight into the types
    that are needed. NULL, or a NULL in messages, for a line that needs a closer
    look with ``json_record``."""
    return _typed(line, _MARKED_RECORD)


def typed_message(line: str) -> str:
    """The same for a line that holds one message."""
    return _typed(line, _MARKED_MESSAGE)


def raw_messages(values: str) -> str:
    """Raw messages of an array<variant>."""
    role, content = part("_v", "$.role", "string"), part("_v", "$.content")
    return f"transform({values}, _v -> named_struct('role', {role}, 'content', {content}))"
