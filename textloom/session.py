"""Session factory used by tests, the bench and local runs; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "textloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """Local session with adaptive execution; an existing session is returned unchanged."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.driver.memory": os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(max(8, cpus)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-ship-"), "textloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith((".py", ".toml")):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
