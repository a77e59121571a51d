"""Errors of the domain. Problems of the data are ValueErrors, as DomainError is too."""


class DomainError(ValueError):
    """A rule of the domain forbids it."""


class NotFoundError(DomainError):
    """There is no such unit or reconciliation."""


class ConflictError(DomainError):
    """It contradicts what is stored."""
