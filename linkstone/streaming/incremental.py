"""Extension: new query records are matched as they arrive, each batch against the static targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkstone.functions.text import profiled
from linkstone.operators import blocking


def match_stream(queries: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, profile: str = "P", top_k: int | None = None) -> StreamingQuery:
    """queries: a stream of entity records; targets: profiled records. sink gets each batch's candidates and its number.

    A batch's number makes a sink's write repeatable after a restart.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(blocking.block(profiled(batch, profile), targets, profile, top_k=top_k), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
