"""Partition folders of stored tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame


def partition_values(stored: DataFrame, name: str) -> list[str]:
    """Values of a partition column, from the names of the folders that have files.

    A folder that holds an empty file counts: a run without rows is a run.
    """
    found = (re.search(rf"/{re.escape(name)}=([^/]*)/", path) for path in stored.inputFiles())
    return sorted({unquote(m[1]) for m in found if m})
