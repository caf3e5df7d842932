"""Errors of the engine."""


class NotFound(LookupError):
    """No row, sequence or table of that name."""


class InvalidCoordinates(ValueError):
    """A start after its end, or an end beyond the sequence."""


class EncodingError(ValueError):
    """A symbol outside the alphabet."""


class CorruptData(ValueError):
    """Stored data that do not match their checksum, digest or format."""
