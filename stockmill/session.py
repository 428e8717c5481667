"""Session set-up and the shared working folder."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_STATE = "spark.sql.streaming.stateStore"
#: State of streams lies on disk, behind a cache of fixed size per executor: the session's default
#: store holds every key on the heap.  Commits store whole files, which the next run opens; it
#: would replay a changelog key by key.
STATE_SETTINGS = {
    f"{_STATE}.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "false",
}

_local_dirs = {}


def build_session(app_name="stockmill", master=None, shuffle_partitions=None, **conf):
    """A session with the settings this package is tuned for.

    Cluster submissions usually bring their own session; every operator works with it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.numRecentProgressUpdates": "10000",
        **STATE_SETTINGS,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_state_on_disk(spark):
    """``STATE_SETTINGS`` for the streams that a session starts from now on, where it has no value
    of its own.  A checkpoint made with another state store goes on with that one."""
    for key, value in STATE_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark):
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets one temporary folder that is
    removed when the process ends.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="stockmill-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_dir(spark, label):
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _file_system(spark, path):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark, path):
    files, path = _file_system(spark, path)
    return files.exists(path)


def names(spark, path):
    """Names in a folder, or none where it is missing."""
    files, path = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def folders(spark, path):
    """Folders in a folder, without hidden ones."""
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names(spark, path)) if n[0] not in "._"]
