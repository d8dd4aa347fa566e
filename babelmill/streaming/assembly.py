"""Lines and JSON objects put together from the chunks of a connection, wherever these are cut."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from babelmill.functions.replies import objects_in

#: The state store that keeps values and maps by key; a stream with assembled() needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENTS = "connection string, nth long, payload string"


def cut_lines(held: bytes, last: bool) -> tuple[list[str], bytes]:
    """The payloads of whole `data: ` lines, and the bytes of a line that has not come to its end."""
    *whole, tail = held.split(b"\n")
    if last and tail:
        whole, tail = [*whole, tail], b""
    lines = (line.removesuffix(b"\r") for line in whole)
    return [line[6:].decode("utf-8", "replace") for line in lines if line.startswith(b"data: ")], tail


def cut_objects(held: bytes, last: bool) -> tuple[list[str], bytes]:
    """The top-level JSON objects that are complete, and the bytes from the first that is not."""
    text = held.decode("utf-8", "ignore")
    found, resume = objects_in(text)
    return found, held[len(text[:resume].encode()) :]


CUTTERS = {"lines": cut_lines, "objects": cut_objects}


class Assembler(StatefulProcessor):
    """Keeps, for each connection, the tail that was cut, the number of the next chunk and of the next event, and chunks that came
    before their turn."""

    def __init__(self, kind: str) -> None:
        self.cut = CUTTERS[kind]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "tail binary, chunk long, event long")
        self.early = handle.getMapState("early", "chunk long", "bytes binary, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tail, chunk, event = self.at.get() if self.at.exists() else (b"", 0, 0)
        tail = bytes(tail or b"")
        waiting = {int(k[0]): (bytes(v[0]), bool(v[1])) for k, v in self.early.iterator()}
        old = set(waiting)
        for frame in rows:
            for n, data, last in zip(frame["chunk"], frame["bytes"], frame["last"], strict=True):
                if int(n) >= chunk:  # a chunk sent twice counts once
                    waiting[int(n)] = (bytes(data or b""), bool(last))
        out = []
        while chunk in waiting:
            data, last = waiting.pop(chunk)
            found, tail = self.cut(tail + data, last)
            out += [(key[0], event + i, x) for i, x in enumerate(found)]
            chunk, event = chunk + 1, event + len(found)
        for n in old - set(waiting):
            self.early.removeKey((n,))
        for n in set(waiting) - old:
            self.early.updateValue((n,), waiting[n])
        self.at.update((tail, chunk, event))
        yield pd.DataFrame(out, columns=["connection", "nth", "payload"]).astype({"nth": "int64"})

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, kind: str = "lines") -> DataFrame:
    """EVENTS of a stream of chunks(connection, chunk, bytes, last): `lines` gives the payloads of server-sent events, `objects` the JSON
    objects of a text that is still being written.

    Chunks of a connection are numbered from 0 and may come in any order; `last` says that nothing follows.
    """
    held = chunks.select("connection", "chunk", "bytes", F.coalesce("last", F.lit(False)).alias("last"))
    return held.groupBy("connection").transformWithStateInPandas(Assembler(kind), EVENTS, "append", "none")
