"""Structured Streaming forms: page views by hour, linking of arriving claims, the second hop of arriving scores, first scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators import docs as D
from evidentia.operators import linking as K
from evidentia.plans.scratch import written


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of the Parquet files of a folder whose names match the pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_pageviews(events: DataFrame, ts: str = "ts", doc: str = "doc", views: str = "views", width: str = "1 hour", late: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """(start, stop, doc, views): views summed by window; rows later than the watermark are dropped. Tumbling; ``slide`` makes sliding, ``gap`` session windows."""
    w = F.session_window(ts, gap) if gap else F.window(ts, width, slide) if slide else F.window(ts, width)
    got = events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(doc).alias("doc")).agg(F.sum(views).alias("views"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "doc", "views")


def stream_dedup_scores(scores: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first score of each pair; state is kept for the watermark's time only."""
    return scores.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def _each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the batch code on what has arrived. A batch's folder is overwritten when it is replayed, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_link_claims(claims: DataFrame, index: DataFrame, views: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """First-hop links of arriving claims (claim_id, tokens) against the static index and views, ranked by views."""
    trie = K.keyword_trie(index)

    def work(batch: DataFrame) -> DataFrame:
        links = K.link_keywords(batch, index, trie=trie).select("claim_id", "match_key", "doc_id", "priority")
        return D.topk_docs(D.pageview_rank(links, views))

    return _each_batch(claims, work, out, checkpoint)


def best_so_far(selected: DataFrame, ts: str | None = None, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(claim_id, doc_id, line_num, score) of a stream of selected sentences: a claim's best sentence whenever it changes.

    Ties go to the first sentence by (doc_id, line_num), so the last row of a claim doesn't depend on how the input is cut into batches. With ``ts``, the
    column of event times, a claim's state ends when the watermark (``late`` behind) is ``keep`` past its latest sentence, and a later sentence starts anew;
    without it states last. Rows with a null claim, document, line or score are left out.
    """
    kinds = dict(selected.dtypes)
    row_kind = f"doc_id {kinds['doc_id']}, line_num int, score double"
    wait = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        if old and ts and old[3] <= state.getCurrentWatermarkMs():  # its time was up before these rows came
            old = None
        best, latest = old and (-old[2], old[0], old[1]), 0
        for frame in frames:
            top = frame.sort_values(["score", "doc_id", "line_num"], ascending=[False, True, True])
            doc, line, score = (top[c].iloc[0] for c in ("doc_id", "line_num", "score"))  # by column: a row of numbers would be floats, which a long of the state doesn't take
            own = (-float(score), doc.item() if hasattr(doc, "item") else doc, int(line))
            best = own if best is None else min(best, own)
            if ts:
                latest = max(latest, frame["ts"].max().value // 1_000_000)
        now = (best[1], best[2], -best[0])
        until = max(latest, state.getCurrentWatermarkMs()) + wait if ts else 0
        state.update((*now, until))
        if ts:
            state.setTimeoutTimestamp(until)
        if old is None or now != tuple(old[:3]):
            yield pd.DataFrame([(key[0], *now)], columns=["claim_id", "doc_id", "line_num", "score"])

    columns = ["claim_id", "doc_id", F.col("line_num").cast("int").alias("line_num"), F.col("score").cast("double").alias("score")]
    rows = selected.withWatermark(ts, late).select(*columns, F.col(ts).alias("ts")) if ts else selected.select(*columns)
    timer = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.dropna().groupBy("claim_id").applyInPandasWithState(update, f"claim_id {kinds['claim_id']}, {row_kind}", f"{row_kind}, until long", "update", timer)


def stream_second_hop(selected: DataFrame, link_rows: DataFrame, links: DataFrame, views: DataFrame, out: str, checkpoint: str, k: int = 5, ts: str | None = None, keep: str = "7 days", late: str = "1 hour") -> StreamingQuery:
    """Second-hop documents of arriving selected sentences (claim_id, doc_id, line_num, score): links of a claim's best sentence, ranked by views, without those of the first hop.

    Only sentences with links count. Each claim's best sentence is state that lasts from batch to batch; a batch writes the documents of the claims whose best
    sentence it changed, and which sentence that is. ``second_hop_result`` reads the last word on each claim, which is what the batch operators give for all
    sentences at once, however they were cut into batches. A replayed batch overwrites its own folders.
    """
    link_rows, links, views = written(link_rows, "graph"), written(links, "first"), written(views, "views")  # each batch reads them; made once
    linked = selected.join(link_rows.select("doc_id", "line_num").distinct().hint("merge"), ["doc_id", "line_num"], "left_semi")

    def write(batch: DataFrame, number: int) -> None:
        best = written(batch, "best")
        hops = D.best_sentence_links(D.expand_from_sentences(best, link_rows))
        aside = D.pageview_rank(D.sentence_links_as_candidates(hops), views)
        D.topk_docs(D.new_docs_only(aside, links), k).write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        best.write.mode("overwrite").parquet(f"{out}/best/batch={number}")

    return best_so_far(linked, ts, keep, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def second_hop_result(spark: SparkSession, out: str, claim_kind: str = "long", doc_kind: str = "string") -> DataFrame:
    """(claim_id, doc_id, priority, rank): of each claim the documents of the last batch that changed its best sentence."""
    last = spark.read.schema(f"claim_id {claim_kind}, batch long").parquet(f"{out}/best").groupBy("claim_id").agg(F.max("batch").alias("batch"))
    docs = spark.read.schema(f"claim_id {claim_kind}, doc_id {doc_kind}, priority double, rank int, batch long").parquet(f"{out}/docs")
    return docs.join(last, ["claim_id", "batch"], "left_semi").drop("batch")
