"""Conversations as a stream: each keeps its last finished turns, and every turn goes to a table.

Events are rows (conv_id, turn, kind, text, passages): ``said`` is a turn that
is finished as it comes; ``asked`` is a question with the passages found for it,
answered by a generator that gets the conversation's last turns; ``reset``
forgets them.  A question without passages gets the fixed answer and is no part
of the conversation.  State is a list of at most ``most`` turns a conversation,
in the stream's state store; a conversation that is silent for ``quiet`` seconds
is forgotten, too.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from glosspan.operators.answers import NOTHING_FOUND, extractive

EVENTS = "conv_id string, turn long, kind string, text string, passages array<string>"
#: ``remembered`` are the numbers of the turns that the conversation holds after this one, oldest first.
TURNS = "conv_id string, turn long, kind string, text string, answer string, context_turns int, remembered array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversation(StatefulProcessor):
    def __init__(self, most: int, quiet: float, generate: Callable):
        self.most, self.quiet, self.generate = most, quiet, generate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, question string, answer string")

    def _answer(self, question: str, passages: list[str], held: list[tuple]) -> str:
        history = [m for _, q, a in held for m in ({"role": "user", "content": q}, {"role": "assistant", "content": a}) if m["content"] is not None]
        takes = "history" in inspect.signature(self.generate).parameters
        made = self.generate(question, passages, **({"history": history} if takes else {}))
        return getattr(made, "text", made)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        events = pd.concat(list(rows)).sort_values(["turn", "kind", "text"], kind="stable", na_position="first")
        out = []
        for turn, kind, text, passages in events[["turn", "kind", "text", "passages"]].itertuples(index=False):
            context, answer = len(held), None
            if kind == "reset":
                held = []
            elif kind == "said":
                held.append((turn, text, None))
            else:
                found = [] if passages is None else list(passages)
                answer = self._answer(text, found, held) if found else NOTHING_FOUND
                if found:
                    held.append((turn, text, answer))
            held = held[-self.most :] if self.most else []
            out.append((key[0], turn, kind, text, answer, context, [t for t, *_ in held]))
        if held:
            self.turns.put(held)
        else:
            self.turns.clear()
        if self.quiet:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in TURNS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield pd.DataFrame(columns=[f.split(" ")[0] for f in TURNS.split(", ")])


def followed(events: DataFrame, most: int = 10, quiet: float = 0, generate: Callable = extractive) -> DataFrame:
    """The turns of a stream of events; ``quiet`` 0 keeps conversations for good."""
    spark = events.sparkSession
    if ROCKS != spark.conf.get(PROVIDER, None):
        spark.conf.set(PROVIDER, ROCKS)  # lists and timers need this store
    mode = "processingTime" if quiet else "none"
    return events.groupBy("conv_id").transformWithStateInPandas(Conversation(most, quiet, generate), TURNS, "append", mode)


def kept(turns: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the turns to a table, each once, also over restarts."""
    return turns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()


def windows(table: DataFrame) -> DataFrame:
    """(conv_id, turn): the turns that each conversation remembers after its last one in the table."""
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    ends = table.withColumn("_last", last).where("_last = 1")
    return ends.select("conv_id", F.explode("remembered").alias("turn"))


def replayed(spark: SparkSession, rows: str, home: str, most: int, schema: StructType) -> DataFrame:
    """A table of finished turns (conv_id, turn, text) run through the stream once; the table of turns that it leaves below ``home``."""
    # As a pattern, the path may name a file as well as a folder of files.
    told = spark.readStream.schema(schema).parquet(f"{rows[:-1]}[{rows[-1]}]")
    events = told.select(F.col("conv_id").cast("string"), "turn", F.lit("said").alias("kind"), "text", F.lit(None).cast("array<string>").alias("passages"))
    query = kept(followed(events, most), f"{home}/turns", f"{home}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.schema(TURNS).parquet(f"{home}/turns")
