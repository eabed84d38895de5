"""Files that arrive in a folder become books, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..enrich import ModelClient
from ..library import Library

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(library: Library, folder: str, checkpoint: str, client: Callable[[], ModelClient], files_per_batch: int = 100, **trigger) -> StreamingQuery:
    """Start ingesting new files under ``folder``. A batch that runs again adds nothing, since every stage skips what is there."""
    stream = library.spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def load(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            library.ingest_files(batch, client, force=True)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
