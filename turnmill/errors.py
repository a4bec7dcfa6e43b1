"""Errors raised on the driver; executors only ever mark rows."""


class ImportFormatError(ValueError):
    """A dump line that is not in the announced format."""

    def __init__(self, error_class, detail=None, file=None, lineno=None):
        self.error_class, self.detail = error_class, detail
        self.file, self.lineno = file, lineno
        where = "" if lineno is None else f"line {lineno}: "
        more = "" if not detail else f" ({detail})"
        source = "" if not file else f" in {file}"
        super().__init__(f"{where}{error_class}{more}{source}")


class EmptyResultError(ValueError):
    """Nothing left to train on: no conversation, no line or no task."""
