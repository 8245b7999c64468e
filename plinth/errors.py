"""Errors of sources."""


class SourceError(Exception):
    """A source can't be read."""


class PlatformNotSupportedError(SourceError):
    """No platform is known for a city or URL."""


class PortalError(SourceError):
    """A portal's answer can't be used."""


class ModelError(Exception):
    """A provider of embeddings or text that can't be asked or gives no answer."""


class CacheConflictError(RuntimeError):
    """Two saves to one cache at once."""
