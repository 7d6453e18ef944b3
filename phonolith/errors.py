"""Errors that a run reports and ends with code 1."""


class LibraryError(RuntimeError):
    """Anything the user can mend."""


class MissingDependencyError(LibraryError):
    """A program or module that is not installed."""


class SeparationError(LibraryError):
    """A separator that fails or whose output fails the gate."""


class CollectionError(LibraryError):
    """A collection that cannot be read or written."""
