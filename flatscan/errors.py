"""What can be wrong with a file: three classes, each with the place where it shows."""

from __future__ import annotations


class ScanError(Exception):
    """A file that can't be read; the location's parts are None where they don't apply."""

    def __init__(self, message: str, byte_offset: int | None = None, row_group: int | None = None, column: int | None = None, page: int | None = None):
        super().__init__(message)
        self.byte_offset, self.row_group, self.column, self.page = byte_offset, row_group, column, page

    def __reduce__(self):  # noqa: ANN204  errors cross from workers to the driver
        return type(self), (str(self), self.byte_offset, self.row_group, self.column, self.page)


class FormatError(ScanError):
    """The bytes break the format."""


class TruncatedError(FormatError):
    """The bytes end inside a structure."""


class UnsupportedFeatureError(ScanError):
    """The file is well-formed but uses what this profile leaves out."""


class LimitExceededError(ScanError):
    """A configured limit would be passed."""
