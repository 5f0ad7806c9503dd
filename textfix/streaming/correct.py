"""Correction of a growing table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textfix.config import CorrectionConfig
from textfix.operators.index import DictionaryIndex, dictionary_index
from textfix.plans.correct import Corrector, correct, identity
from textfix.session import scratch


def stream_correct(
    texts: DataFrame,
    dictionary: DataFrame | DictionaryIndex,
    path: str,
    checkpoint: str,
    corrector: Corrector = identity,
    cfg: CorrectionConfig | None = None,
    text: str = "text",
    *,
    id_cols: list[str],
    available_now: bool = False,
) -> StreamingQuery:
    """Run the batch job on every micro-batch and write it below ``path``.

    Each batch owns one directory and overwrites it, so a batch repeated after a failure leaves its
    rows once, and deletes the scratch tables it made. The keys of the dictionary are written once, when
    the stream starts (or before: give its index), and only read by the batches. Read the result back with ``spark.read.parquet(path)``.
    """

    cfg = cfg or CorrectionConfig()
    if cfg.use_speller and not isinstance(dictionary, DictionaryIndex):
        edits = min(cfg.speller.max_edit_distance, cfg.speller.autocorrect_max_distance)
        dictionary = dictionary_index(dictionary, edits)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for its words and again for rewriting
        try:
            with scratch(batch.sparkSession):
                fixed = correct(batch, dictionary, corrector, cfg, text, id_cols=id_cols)
                fixed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
