"""What goes wrong, split as Python users expect it."""


class FormatError(ValueError):
    """A file does not follow its format."""


class DTypeError(ValueError):
    """An array has a type that the operation does not take."""


class ArgumentError(ValueError):
    """An argument does not fit the data."""


class MissingName(KeyError):
    """A named array or group does not exist."""
