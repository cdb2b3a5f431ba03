"""Analytics over large content libraries, expressed with Spark DataFrames."""

from __future__ import annotations

import os


def on_workers(spark) -> None:
    """Let Python workers that see this folder import the package, wherever the driver was started.

    On a cluster without a common folder, ship the package with ``--py-files`` as usual.
    """
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
