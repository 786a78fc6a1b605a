"""What the operators of this subpackage take from ``tidemark.work``, and names for files of tasks."""

from __future__ import annotations

import uuid

from pyspark import TaskContext

from tidemark.work import cut as materialize, discard, fresh as new_folder, open_fs, passing, shared_folder as shared_dir

__all__ = ["discard", "materialize", "new_folder", "open_fs", "passing", "shared_dir", "task_name"]


def task_name(stem: str) -> str:
    """A name no other attempt of this or another task takes; readers follow the manifest of the attempt that succeeded."""
    c = TaskContext.get()
    return f"{stem}-{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
