"""Union by column name, and the session setting it needs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from sparkodds.session import REQUIRED


def union(*frames: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all frames, columns matched by name; with ``missing`` absent
    columns are NULL.

    Spark 4.1 lets a union of equally partitioned frames count as partitioned
    and skips the shuffle above it. When adaptive execution then re-plans the
    branches, rows of one key can sit in different partitions and grouped
    results come out wrong (``tests/test_unions.py`` shows it). Sessions must
    have that shortcut off, as ``session.configure`` does; a warning says so where
    it is on.
    """
    conf = frames[0].sparkSession.conf
    for key, value in REQUIRED.items():
        if conf.get(key, "true") != value:
            warnings.warn(f"{key} should be {value}: see sparkodds.session.configure", stacklevel=2)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=missing)
    return out
