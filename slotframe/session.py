"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH")) if x)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("slotframe")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session; needed where it isn't installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_slotframe_shipped", False):
        return
    top = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="slotframe-code-")) / "slotframe.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._slotframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local session without one uses its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/slotframe-scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder there."""
    return f"{shared_folder(spark)}/slotframe-{uuid.uuid4().hex}/{tag}"
