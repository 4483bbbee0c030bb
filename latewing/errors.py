"""What can go wrong, by name."""


class LatewingError(Exception):
    """Base of all errors of this library."""


class ConfigError(LatewingError):
    """A configuration file that cannot be read or holds impossible values."""


class EncoderError(LatewingError):
    """An encoder that cannot be found, or was given nothing to encode."""


class DimensionError(LatewingError):
    """Query and page vectors of different widths."""


class RegistryError(LatewingError):
    """A registry operation on what is not there."""


class EmptyQueryError(LatewingError):
    """An empty query string at the interface."""


class PageRangeError(LatewingError, ValueError):
    """A page number outside its document."""


class ConfigWarning(UserWarning):
    """A configuration file that is missing; defaults are used."""


class EncoderWarning(UserWarning):
    """An encoder chosen because none matched."""
