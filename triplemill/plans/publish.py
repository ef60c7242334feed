"""Publishing the folders of a job together."""

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from triplemill.plans.scratch import files

COMPLETE = "_COMPLETE"


@contextmanager
def published(spark: SparkSession, out: str) -> Iterator[str]:
    """Folder to write a job's folders to; they appear under ``out`` when all of
    them are done.

    They are written beside their place and then renamed, in the order of their
    names, over what an earlier run left under the same names. A note, ``_COMPLETE``,
    with these names is taken away before the first and written after the last, so
    a reader that finds it finds one whole run. After an error, ``out`` is as it was.
    """
    out = out.rstrip("/")
    stage = f"{out}/_stage-{uuid.uuid4().hex}"
    store = files(spark, out)
    try:
        yield stage
    except BaseException:
        store.remove(stage)
        raise
    names = store.names(stage)
    store.remove(f"{out}/{COMPLETE}")
    for name in names:
        store.remove(f"{out}/{name}")
        store.rename(f"{stage}/{name}", f"{out}/{name}")
    store.remove(stage)
    store.write(f"{out}/{COMPLETE}", json.dumps(names))


def is_complete(spark: SparkSession, out: str) -> bool:
    """Whether the folders under ``out`` are of one whole run."""
    return files(spark, out).exists(f"{out.rstrip('/')}/{COMPLETE}")
