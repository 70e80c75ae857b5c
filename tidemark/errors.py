"""What can go wrong in a store."""


class StoreError(Exception):
    """Any error of a store."""


class InvalidOption(StoreError):
    """A setting out of its range."""


class KeyNotFound(StoreError):
    """The key is absent, deleted or expired."""


class EmptyKey(StoreError):
    """A key of no bytes."""


class InvalidKey(StoreError):
    """A key with the reserved prefix."""


class BannedKey(StoreError):
    """A key of a banned namespace."""


class TooLong(StoreError):
    """A key or value above its limit."""


class TxnTooBig(StoreError):
    """A transaction whose writes reach the limit."""


class ReadOnlyTxn(StoreError):
    """A write in a transaction that only reads."""


class DiscardedTxn(StoreError):
    """Use of a transaction after its end."""


class Conflict(StoreError):
    """Another transaction committed a write to a key that this one read."""


class BlockedWrites(StoreError):
    """Writes are blocked."""


class MissingTables(StoreError):
    """The manifest has tables that aren't there."""
