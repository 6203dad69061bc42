"""Settings of an engine, from Spark's configuration or the environment, and its log."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class Config:
    """Each setting may come as spark.quarry.<name> or QUARRY_<NAME>; Spark's wins."""

    text_k: int = 10
    image_k: int = 5
    #: Characters to which blocks of text are cut on ingestion, 0 to leave them as they are.
    chunk_size: int = 0
    chunk_overlap: int = 200
    #: Dimensions that vectors must have, 0 for that of the stored ones.
    text_dimension: int = 0
    image_dimension: int = 0
    least_vector: float = 0.5
    least_text: float = 0.5
    log_file: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        out = cls()
        for f in fields(cls):
            value = spark.conf.get(f"spark.quarry.{f.name}", os.environ.get(f"QUARRY_{f.name.upper()}"))
            if value is not None:
                setattr(out, f.name, type(getattr(out, f.name))(value))
        return out


def logger(name: str = "quarry", file: str = "") -> logging.Logger:
    """A log to the console, and to a file if one is given; asked twice it is the same, with the same handlers."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    shape = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    have = {getattr(h, "baseFilename", "") for h in log.handlers}
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    if file and os.path.abspath(file) not in have:
        log.addHandler(logging.FileHandler(file, encoding="utf-8"))
    for h in log.handlers:
        h.setFormatter(shape)
    return log


def check_setup(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether what an engine needs is there: Arrow, adaptive execution, a folder that can be written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/.setup")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(place, True).close()
        writable = bool(fs.delete(place, False))
    except Exception:
        writable = False
    try:
        import pyarrow  # noqa: F401

        arrow = True
    except ImportError:
        arrow = False
    return {"arrow": arrow, "adaptive": spark.conf.get("spark.sql.adaptive.enabled", "true") == "true", "writable": writable}
