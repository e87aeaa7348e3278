"""The scratch folders' functions, as the queries import them."""

from beamframe.scratch import delete_path, file_system, scratch_path, scratch_scope, stored

__all__ = ["delete_path", "file_system", "scratch_path", "scratch_scope", "stored"]
