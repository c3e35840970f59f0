"""Order books kept message by message: the book after every message, and why a message was refused.

A snapshot starts a book anew, so a long history is folded in pieces, one from each (fit) snapshot to the next, in parallel; within
a piece messages are taken in order of arrival, with the levels of one book in memory. The same steps run on streams.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voltide.sources.shared import shuffle_partitions

from .timeseries import carry_scan

DEPTH = 15
#: Rows of a frame that a stream's step puts out.
FRAME = 1000
#: Messages of a block, about; a block ends before a snapshot where one is among the next as many.
BLOCK = 1000
LEVEL = pa.struct([("price", pa.string()), ("quantity", pa.string())])
#: Sides of a venue's book and of a contract's, with whether the highest price is the best.
VENUE_SIDES = (("bid", True), ("ask", False))
CONTRACT_SIDES = (("yes", True), ("no", True))


#: What counts as a number in a level.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _number(text: str | None) -> Decimal | None:
    return Decimal(text) if text is not None and re.match(NUMBER, text) else None


def _fit(levels: str, sides) -> Column:
    """Whether a snapshot's levels are all of known sides, with numbers that aren't below 0; a refused one starts nothing."""
    number = lambda x: F.coalesce(x.rlike(NUMBER), F.lit(False))
    below = lambda x: x.rlike("^-.*[1-9]")
    fine = lambda x: F.coalesce(x["side"].isin([name for name, _ in sides]) & number(x["price"]) & number(x["quantity"]) & ~below(x["quantity"]), F.lit(False))
    return F.coalesce(F.forall(levels, fine), F.lit(True))


class Side:
    """The levels of a side in order of price, and the texts that go out; a level's price is as it came first."""

    def __init__(self, high: bool):
        self.high = high
        self.prices: list[Decimal] = []
        self.quantities: list[Decimal] = []
        self.texts: tuple[list[str], list[str]] = [], []

    def _place(self, price: Decimal) -> tuple[int, bool]:
        i = bisect_left(self.prices, price)
        return i, i < len(self.prices) and self.prices[i] == price

    def get(self, price: Decimal) -> Decimal:
        i, there = self._place(price)
        return self.quantities[i] if there else Decimal(0)

    def put(self, price: Decimal, quantity: Decimal) -> None:
        """Sets a level's quantity; 0 takes the level out."""
        i, there = self._place(price)
        if not quantity:
            if there:
                del self.prices[i], self.quantities[i], self.texts[0][i], self.texts[1][i]
        elif there:
            self.quantities[i], self.texts[1][i] = quantity, format(quantity, "f")
        else:
            self.prices.insert(i, price)
            self.quantities.insert(i, quantity)
            self.texts[0].insert(i, format(price, "f"))
            self.texts[1].insert(i, format(quantity, "f"))

    def best(self, depth: int) -> list[list[str]]:
        """Prices and quantities of the best levels, best first."""
        return [held[: -depth - 1 : -1] if self.high else held[:depth] for held in self.texts]


class Book:
    """One book. signed: a delta's quantity is added to its level, and sequences must grow; else it replaces the level's.

    Reasons for refusal, first found: before_snapshot and stale (signed deltas only), incomplete (no level, or an unknown
    side), number (not finite), negative (a level, or what a delta would leave). A refused message changes nothing, its
    sequence neither.
    """

    def __init__(self, signed: bool, sides: tuple[tuple[str, bool], ...], last: int | None = None, *levels: list[str]):
        """Empty, or as `whole` gave it."""
        self.signed, self.sides, self.last = signed, sides, last
        self.number = lru_cache(maxsize=1 << 12)(_number)
        self.levels = {name: Side(high) for name, high in sides}
        for side, price, quantity in zip(*levels):
            self.levels[side].put(Decimal(price), Decimal(quantity))

    def whole(self) -> tuple[int | None, list[str], list[str], list[str]]:
        """The last sequence, and of all levels the side, price and quantity."""
        levels = [(name, *level) for name, side in self.levels.items() for level in zip(*side.texts)]
        return self.last, *([list(x) for x in zip(*levels)] if levels else ([], [], []))

    def apply(self, kind: str, sequence: int | None, levels: list[tuple] | None) -> str | None:
        """Takes a message (snapshot or delta; levels: side, price, quantity); the reason, if it is refused."""
        fresh = kind == "snapshot"
        if self.signed and not fresh:
            if self.last is None:
                return "before_snapshot"
            if sequence is None or sequence <= self.last:
                return "stale"
            if not levels:
                return "incomplete"
        new: dict[str, dict[Decimal, Decimal]] = {name: {} for name in self.levels}
        for side, price, quantity in levels or []:
            if side not in new:
                return "incomplete"
            price, quantity = self.number(price), self.number(quantity)
            if price is None or quantity is None:
                return "number"
            if self.signed and not fresh:
                quantity += new[side][price] if price in new[side] else self.levels[side].get(price)
            if quantity < 0:
                return "negative"
            new[side][price] = quantity
        for side, changes in new.items():
            if fresh:
                self.levels[side] = Side(self.levels[side].high)
            for price, quantity in changes.items():
                self.levels[side].put(price, quantity)
        self.last = sequence if sequence is not None else self.last
        return None

    def best(self, depth: int) -> list[list[list[str]]]:
        """Prices and quantities of the best levels of each side, best first, as text."""
        return [self.levels[name].best(depth) for name, _ in self.sides]


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _levels(column: pa.ListArray) -> Iterator[list[tuple] | None]:
    """Side, price and quantity of each message's levels; a level that is null has none of them."""
    each, place = column.flatten(), 0
    flat = list(zip(*[_texts(each.flatten()[each.type.get_field_index(c)]) for c in ("side", "price", "quantity")]))
    for n in column.value_lengths().to_pylist():
        yield None if n is None else flat[place : place + n]
        place += n or 0


def _messages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Kind, sequence and levels of each message."""
    return zip(_texts(batch.column("kind")), batch.column("sequence").to_pylist(), _levels(batch.column("levels")))


def _books_after(messages: Iterable[tuple], sides, depth: int) -> list[pa.Array]:
    """Reasons, and a column a side of the best levels after each of the messages: book, kind, sequence, levels."""
    reasons, columns = [], [([0], [], []) for _ in sides]
    for book, *message in messages:
        reasons.append(book.apply(*message))
        for (ends, prices, quantities), best in zip(columns, book.best(depth)):
            prices += best[0]
            quantities += best[1]
            ends.append(len(prices))
    side = lambda ends, *texts: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in texts], fields=list(LEVEL)))
    return [pa.array(reasons, pa.string()), *[side(*column) for column in columns]]


def _schema(df_schema: T.StructType, key: list[str], at: str, sides) -> T.StructType:
    level = T.ArrayType(T.StructType([T.StructField("price", T.StringType()), T.StructField("quantity", T.StringType())]))
    own = [df_schema[c] for c in (*key, at)]
    return T.StructType([*own, T.StructField("sequence", T.LongType()), T.StructField("reason", T.StringType()), *[T.StructField(name, level) for name, _ in sides]])


def running_books(messages: DataFrame, key: list[str], at: str, signed: bool, sides=VENUE_SIDES, depth: int = DEPTH) -> DataFrame:
    """A row a message: key, at, sequence, reason (null: taken), and the best `depth` levels of each side after it.

    messages: key, at (order of arrival, a whole number that differs within a key), sequence, kind (snapshot, else a delta),
    levels (array of side, price, quantity as text). A message without levels that isn't a snapshot changes nothing
    (signed: is refused); a null array of a snapshot empties the book.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installation of this module
    rows = messages.select(*key, at, F.col("sequence").cast("long").alias("sequence"), "kind", "levels")
    rows = carry_scan(rows, at, key, F.lit(1.0), ((F.col("kind") == "snapshot") & _fit("levels", sides)).cast("double"), "__piece")
    order = [*key, "__piece"]
    rows = rows.repartition(shuffle_partitions(messages.sparkSession), *order).sortWithinPartitions(*order, at)
    schema, n = _schema(messages.schema, key, at, sides), len(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, book = None, None

        def taken(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal piece, book
            for message, *own in zip(_messages(batch), *[batch.column(k).to_pylist() for k in (*range(n), n + 4)]):
                if own != piece:
                    piece, book = own, Book(signed, sides)
                yield book, *message

        for batch in batches:
            kept = [batch.column(k) for k in range(n + 2)]
            yield pa.RecordBatch.from_arrays([*kept, *_books_after(taken(batch), sides, depth)], schema.names)

    return rows.mapInArrow(fold, schema)


class StreamingBook(StatefulProcessor):
    """`Book` as the state of a key; a micro-batch's messages are taken in order of arrival, and go out in frames of bounded size."""

    def __init__(self, at: str, signed: bool, sides, depth: int, names: list[str]):
        self.at, self.signed, self.sides, self.depth, self.names = at, signed, sides, depth, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", "last long, side array<string>, price array<string>, quantity array<string>")

    def held(self) -> Book:
        """The book of the state."""
        return Book(self.signed, self.sides, *(self.state.get() if self.state.exists() else ()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, out = self.held(), []
        for r in pd.concat(list(rows), ignore_index=True).sort_values(self.at).itertuples(index=False):
            sequence = None if pd.isna(r.sequence) else int(r.sequence)
            levels = None if r.levels is None else [[x and x[c] for c in ("side", "price", "quantity")] for x in r.levels]
            reason = book.apply(r.kind, sequence, levels)
            out.append([*key, getattr(r, self.at), sequence, reason, *[[{"price": p, "quantity": q} for p, q in zip(*side)] for side in book.best(self.depth)]])
            if len(out) == FRAME:
                yield pd.DataFrame(out, columns=self.names)
                out = []
        self.state.update(book.whole())
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class StreamingBlocks(StreamingBook):
    """The same state over blocks of messages: each goes out with the book before it, from which the books after its messages are
    made elsewhere. Messages are taken here only where the state or a block that starts with no snapshot needs them.
    """

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, behind = self.held(), []

        def caught_up() -> None:
            while behind:
                for message in _messages(_unpacked(behind.pop(0))):
                    book.apply(*message)

        for block in pd.concat(list(rows), ignore_index=True).sort_values("block_first").itertuples(index=False):
            if block.block_fresh:
                book, behind = Book(self.signed, self.sides), []
            else:
                caught_up()
            yield pd.DataFrame([[*key, None if block.block_fresh else json.dumps(book.whole()), block.block_messages]], columns=self.names)
            behind.append(block.block_messages)
        caught_up()
        self.state.update(book.whole())


BLOCKS = T.StructType().add("block_key", T.StringType()).add("block_first", T.LongType()).add("block_fresh", T.BooleanType()).add("block_messages", T.BinaryType())


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row a block: its key as a text, the place of its first message, whether that one is a snapshot that starts the book anew,
    and the messages. Columns in: `n` of the key, at, sequence, kind, levels, whether a message starts a book, the key's text.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    places = table.column(n).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
    keys = table.column(n + 5).combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((places, keys))
    table, places, keys = table.take(pa.array(order)).combine_chunks(), places[order], keys[order]
    fresh = table.column(n + 4).to_numpy().astype(bool)
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
    firsts = [0]
    while firsts[-1] < len(keys):
        end = ends[np.searchsorted(ends, firsts[-1], "right")]
        cut = firsts[-1] + BLOCK
        later = np.searchsorted(starts, cut)
        if later < len(starts) and starts[later] < cut + BLOCK:
            cut = starts[later]
        firsts.append(min(cut, end))
    (messages,), firsts, ends = table.select(range(n + 4)).to_batches(), np.array(firsts[:-1]), firsts[1:]
    packed = pa.array([_packed(messages.slice(a, b - a)) for a, b in zip(firsts, ends)], pa.binary())
    texts = table.column(n + 5).take(pa.array(firsts)).combine_chunks()
    yield pa.RecordBatch.from_arrays([texts, pa.array(places[firsts]), pa.array(fresh[firsts]), packed], BLOCKS.names)


def _packed(messages: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, messages.schema) as out:
        out.write_batch(messages)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def stream_books(messages: DataFrame, key: list[str], at: str, signed: bool, sides=VENUE_SIDES, depth: int = DEPTH) -> DataFrame:
    """`running_books` of a stream; needs the RocksDB state store. A batch that comes late counts as arriving late.

    A key's messages of a micro-batch are put in order and packed into blocks by one task; the stateful step finds the book
    before each block, and the books after messages are made block by block in as many tasks as a shuffle has. So let the
    source bound micro-batches (maxFilesPerTrigger, maxOffsetsPerTrigger); rows out and the state don't grow with them.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    schema, n = _schema(messages.schema, key, at, sides), len(key)
    starts = (F.col("kind") == "snapshot") & F.col("sequence").isNotNull() & _fit("levels", sides)
    rows = messages.select(*key, at, F.col("sequence").cast("long").alias("sequence"), "kind", "levels", F.to_json(F.struct(*key)).alias("__key"))
    rows = rows.repartition("__key").select(*rows.columns[:-1], F.coalesce(starts, F.lit(False)).alias("__fresh"), "__key")

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, block in zip(batch.column("block_before").to_pylist(), batch.column("block_messages").to_pylist()):
                book, sent = Book(signed, sides, *(json.loads(before) if before else ())), _unpacked(block)
                yield pa.RecordBatch.from_arrays([*sent.columns[: n + 2], *_books_after(((book, *m) for m in _messages(sent)), sides, depth)], schema.names)

    # keys are texts here, since a frame of the state's step would turn whole numbers that may be null into others
    settled = T.StructType([BLOCKS["block_key"], T.StructField("block_before", T.StringType()), BLOCKS["block_messages"]])
    step = StreamingBlocks(at, signed, sides, depth, settled.names)
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, n), BLOCKS).groupBy("block_key").transformWithStateInPandas(step, settled, "append", "none")
    return blocks.repartition(shuffle_partitions(messages.sparkSession)).mapInArrow(after, schema)
