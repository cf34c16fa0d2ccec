"""What driver and executors share: folders, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on one machine (tests) a new temporary folder is
    set; on a cluster it is an error to name none.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessel.shared.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("tessel.shared.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each context, so that tasks can
    import it wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_tessel_shipped", False):
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="tessel-")) / "tessel.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "tessel").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(out))
        sc._tessel_shipped = True
    return spark
