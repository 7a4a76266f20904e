"""Slice-and-pack over a stream: the tokens that do not fill a pack yet wait in keyed state for the next micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECES = "chunk long, pos long, kind string, pack long, first long, n long"


class Overflow(StatefulProcessor):
    """One chunk's packer: ``held`` is the open tail pack as pieces of rows, ``done`` the tail packs given so far and the last position seen."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", T.StructType([T.StructField("pos", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))
        self.done = handle.getValueState("done", T.StructType([T.StructField("packs", T.LongType()), T.StructField("pos", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pack, last = self.done.get() if self.done.exists() else (0, -1)
        held = [tuple(int(x) for x in r) for r in self.held.get()] if self.held.exists() else []
        used, out = sum(n for _, _, n in held), []
        # a micro-batch's rows of one chunk; positions rise from batch to batch
        batch = pd.concat(list(rows)).sort_values("pos")
        for pos, length in zip(batch["pos"].tolist(), batch["length"].tolist(), strict=True):
            if pos <= last:
                raise ValueError(f"row {pos} of chunk {key[0]} comes after row {last}")
            last = pos
            whole, rest = divmod(length, self.limit)
            out += [(key[0], pos, "full", i, i * self.limit, self.limit) for i in range(whole)]
            first = whole * self.limit
            while rest:
                n = min(rest, self.limit - used)
                held.append((pos, first, n))
                first, rest, used = first + n, rest - n, used + n
                if used == self.limit:
                    out += [(key[0], p, "tail", pack, f, k) for p, f, k in held]
                    pack, used, held = pack + 1, 0, []
        self.done.update((pack, last))
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    def close(self) -> None:
        pass


def slice_and_pack_stream(rows: DataFrame, limit: int) -> DataFrame:
    """The pieces of :func:`lodestone.operators.packing.slice_and_pack` from a stream of ``chunk, pos, length``, as packs fill up.

    State a chunk holds less than a pack.  Rows of a chunk must come in the order of ``pos`` from one micro-batch to the
    next.  The stream needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to :data:`STATE_STORE`.
    """
    return rows.groupBy("chunk").transformWithStateInPandas(Overflow(limit), PIECES, "append", "none")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
