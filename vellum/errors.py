"""Errors of the catalog and of indexing."""


class VellumError(Exception):
    """Base of all errors that this package raises on purpose."""


class NotFound(VellumError):
    """No repository of that name."""


class InvalidName(VellumError):
    """A repository name that is empty, a dot path, or holds a separator."""


class AlreadyExists(VellumError):
    """A repository of that name has been created before."""


class UnknownApplication(VellumError):
    """No strategy is registered for the application."""


# Texts of the error column; fixed, as they are part of the result.
NOT_REGULAR = "not a regular file"
NOT_IN_REPO = "file not under repo path"
UNTERMINATED = "unterminated front matter"
