"""Puts this package on the executors, so that their Python workers can import it wherever they run, and bounds what they are sent at once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Bounds of one Arrow batch: whole texts pass through Python, and by rows alone a batch could hold any number of bytes.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip file, served by the driver."""
    sc = spark.sparkContext
    known = spark.conf.getAll
    for k, v in BATCH.items():
        if k not in known:
            spark.conf.set(k, v)
    if sc.applicationId in _DONE:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexiquarry-"), "lexiquarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lexiquarry", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _DONE.add(sc.applicationId)
