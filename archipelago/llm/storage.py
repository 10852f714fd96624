"""Tables in the folder that all machines share; see :mod:`archipelago.storage`."""

from archipelago.storage import drop, new_path, shared_dir
from archipelago.storage import written as store

__all__ = ["drop", "new_path", "shared_dir", "store"]
