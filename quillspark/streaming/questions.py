"""Questions as a stream: each micro-batch is answered against one index, made before the stream begins or loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.answer import ask
from quillspark.operators.latency import SAMPLES, Timings
from quillspark.operators.retrieve import Index, build_index


def answer_stream(questions: DataFrame, docs: DataFrame, path: str, checkpoint: str, index: Index | None = None, latencies: str | None = None, **options) -> StreamingQuery:
    """Answers a stream of (item_id, text) and appends the answers, by batch, below path.

    docs are indexed once, unless their index is given. A batch that is run again after a failure replaces its own
    folder, so no answer is lost or doubled. latencies: below this path go each batch's milliseconds by stage.
    """
    index = index or build_index(docs)

    def answer(batch: DataFrame, number: int) -> None:
        timings = Timings() if latencies else None
        ask(docs, batch, index=index, timings=timings, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if timings is not None:
            rows = [(name, number, ms) for name, ms in timings.total().items()]
            batch.sparkSession.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("overwrite").parquet(f"{latencies}/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
