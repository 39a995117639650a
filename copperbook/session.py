"""Session settings and the shared scratch folder."""

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "copperbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that hold for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# folders of this machine that a local session was given; they go with the process
_OWN: list[tempfile.TemporaryDirectory] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``.

    A folder of this machine is used only where the setting is absent and the
    session itself is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _OWN.append(tempfile.TemporaryDirectory(prefix="copperbook-", ignore_cleanup_errors=True))
        root = _OWN[-1].name
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
