"""Errors of the public interface; each is raised before anything runs."""


class TesseraError(Exception):
    """Base of all errors of this library."""


class SessionClosedError(TesseraError):
    """The session was closed."""


class UnsupportedOperationError(TesseraError, NotImplementedError):
    """The operation cannot be carried out faithfully."""


class UnorderedOperationError(TesseraError):
    """The operation needs a guaranteed row order."""


class AlignmentError(TesseraError):
    """Objects of different frames cannot be aligned."""


class MaterializationError(TesseraError):
    """A result has another shape than expected."""


class ConcurrentModificationError(TesseraError):
    """A source changed while it was written."""
