"""Exceptions raised on the driver."""


class LoaderError(Exception):
    """A source could not be loaded; carries the cause as text."""
