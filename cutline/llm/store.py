"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from cutline.session import shuffles_freed, stored

__all__ = ["shuffles_freed", "stored"]
