"""Sessions, and the shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "tracewright") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that Python functions may refer to its modules by name."""
    context = spark.sparkContext
    if getattr(context, "_tracewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tracewright-")
    archive = os.path.join(folder, "tracewright.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(archive)
    context._tracewright_shipped = True


def checkpointed(df):
    """``df`` written to the folder of spark.checkpoint.dir, with its lineage cut; a folder for tests is set where the session has none."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no other folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Rows of a task that fit its memory several times over.
ROWS_A_TASK = 500_000


def dealt(df, rows: int, *keys: str):
    """``df`` dealt out by keys over as many tasks as ``rows`` rows need: a session's fixed number lets tasks grow with the input."""
    fixed = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(fixed, -(-rows // ROWS_A_TASK)), *keys)
