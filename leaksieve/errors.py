"""Errors raised while a scan plan is being built."""


class LeaksieveError(Exception):
    """Base class."""


class InvalidCatalog(LeaksieveError):
    """The rule catalogue is missing a mandatory field or is not valid TOML."""


class EmptyCatalog(LeaksieveError):
    """No rule catalogue was found where one was expected."""


class UnsupportedPattern(LeaksieveError):
    """A pattern uses look-around or a back-reference."""


class InvalidDate(LeaksieveError):
    """A date bound is neither YYYY-MM-DD nor RFC 3339."""
