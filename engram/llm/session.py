"""The session helpers, under this subpackage's name."""

from engram.session import cut, shared_folder

__all__ = ["cut", "shared_folder"]
