"""Text tests and byte-limited decoding, as SQL text."""

from __future__ import annotations

# Fixed value: the characters str.strip() removes. Java's White_Space property
# lacks the four separators U+001C to U+001F.
BLANKS = r"\p{IsWhite_Space}\x1c-\x1f"

# Fixed value: default byte limit of a command's captured output.
MAX_OUTPUT_BYTES = 131072


def is_visible(text: str) -> str:
    """Something is left after stripping Unicode white space. Most texts start
    with a visible ASCII character and need no pattern."""
    return f"(ascii({text}) BETWEEN 33 AND 126 OR {text} RLIKE r'[^{BLANKS}]')"


def is_blank(text: str) -> str:
    return f"NOT {is_visible(text)}"


def stripped(text: str) -> str:
    """``text`` without white space at both ends."""
    return f"regexp_replace({text}, r'^[{BLANKS}]++|[{BLANKS}]++$', '')"


def truncate_output(data: str, max_bytes: int = MAX_OUTPUT_BYTES) -> str:
    """The first ``max_bytes`` bytes of a BINARY as text, broken characters
    replaced, and a note of how many bytes were dropped when there were more."""
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    head = f"make_valid_utf8(CAST(substring({data}, 1, {max_bytes}) AS STRING))"
    dropped = f"octet_length({data}) - {max_bytes}"
    # Fixed value: the note on what was dropped.
    return (
        f"CASE WHEN {dropped} > 0 "
        f"THEN concat({head}, '\\n[truncated: ', {dropped}, ' bytes dropped]') ELSE {head} END"
    )
