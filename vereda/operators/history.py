"""Conversation histories and provider chains as scans that stay parallel inside one long sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import scan

# --- fixed values: characters of a token, lengths that are cut, and the mark of a cut text ---
CHARS_A_TOKEN, LONG, KEPT = 3.5, 700, 600
CUT_MARK = "\n[... resultado antigo resumido para caber no contexto]"
MAX_TOKENS = 20_000
#: Turns in one block of a conversation's scan.
BLOCK = 512


def compacted(turns: DataFrame, tool: Column, max_tokens: int = MAX_TOKENS, prompt_chars: int = 0, key: str = "conv_id", order: str = "turn",
              text: str = "text") -> DataFrame:
    """turns with `text` cut where old tool results must give way, and `shortened`.

    The oldest tool results of more than LONG characters are cut to KEPT and a mark, one by one, until the history with the
    prompt has at most max_tokens (estimated from characters). The latest tool result stays whole. So a result is cut exactly
    if what the earlier cuts save does not suffice: a running sum per conversation, carried over blocks of turns. NULL texts
    count no characters.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    marked = turns.withColumn("__tool", F.coalesce(tool, F.lit(False)))
    whole = marked.groupBy(F.col(key).alias("__key")).agg(F.sum(size).alias("__chars"), F.max(F.when(F.col("__tool"), F.col(order))).alias("__last"))
    rows = marked.join(whole, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    can = F.col("__tool") & (F.col(order) < F.col("__last")) & (size > LONG)
    rows = rows.withColumn("__saves", F.when(can, size - (KEPT + len(CUT_MARK))).otherwise(0))
    summed = scan.running_sum(rows, [key], [order], F.col("__saves"), "__saved", F.floor(F.col(order) / BLOCK))
    left = F.col("__chars") + prompt_chars - (F.col("__saved") - F.col("__saves"))
    shortened = (F.col("__saves") > 0) & (F.floor(left / CHARS_A_TOKEN) > max_tokens)
    out = summed.withColumn("shortened", shortened)
    out = out.withColumn(text, F.when(F.col("shortened"), F.concat(F.left(F.col(text), F.lit(KEPT)), F.lit(CUT_MARK))).otherwise(F.col(text)))
    return out.drop("__tool", "__chars", "__last", "__saves", "__saved")


def _step(state: int, works: list[bool]) -> tuple[int, int | None]:
    """The state after a request and the provider that served it: the first from the state on that works."""
    for at in range(state, len(works)):
        if works[at]:
            return at, at
    return state, None


def provider_in_use(events: DataFrame, works: list[Column], key: str, order: list[str], block: Column) -> DataFrame:
    """events with `provider` (the place in the chain that serves the request, NULL if all fail) and `primary` (first one tried).

    works: for each provider of the chain, whether it answers the event; NULL counts as a failure. A provider that serves
    after others failed becomes the first one tried from then on. `block` must not decrease along `order`. Each block becomes
    a transition table (from the first provider tried before it to that after it); tables compose along a key's blocks, and
    blocks are then replayed from their own start, so one hot key spreads over its blocks' tasks.
    """
    n = len(works)
    answers = F.array(*[F.coalesce(w, F.lit(False)) for w in works])
    rows = events.withColumn("__works", answers).withColumn("__block", F.coalesce(block.cast("long"), F.lit(-1)))
    rows = rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("__null", F.col(key).isNull())
    keys = ["__null", "__key", "__block"]
    names, head = events.columns, "__null boolean, __key string, __block long"

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, to, done = None, [], []
        for batch in batches:
            for at, answered in zip(zip(*[batch[k].to_pylist() for k in keys]), batch["__works"].to_pylist()):
                if at != now:
                    done += [(now, to)] if now else []
                    now, to = at, list(range(n))
                to = [_step(s, answered)[0] for s in to]
            yield packed(done)
            done = []
        yield packed([(now, to)] if now else [])

    def packed(found: list) -> pa.RecordBatch:
        columns = [pa.array([at[k] for at, _ in found], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([to for _, to in found], pa.list_(pa.int32()))], names=[*keys, "to"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            begun = []
            for at, to in zip(zip(*[batch[k].to_pylist() for k in keys[:2]]), batch["to"].to_pylist()):
                now, state = at, state if at == now else 0
                begun.append(state)
                state = to[state]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(begun, pa.int32())], names=[*keys, "__start"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for batch in batches:
            served, tried = [], []
            for at, start, answered in zip(zip(*[batch[k].to_pylist() for k in keys]), batch["__start"].to_pylist(), batch["__works"].to_pylist()):
                now, state = at, state if at == now else start
                tried.append(state)
                state, by = _step(state, answered)
                served.append(by)
            own = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(served, pa.int32()), pa.array(tried, pa.int32())], names=[*names, "provider", "primary"])

    def ordered(df: DataFrame, by: list[str], *then: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*keys, *then)

    made = ordered(rows.select(*keys, *order, "__works"), keys, *order).mapInArrow(tables, f"{head}, to array<int>")
    begun = ordered(made, keys[:2]).mapInArrow(starts, f"{head}, __start int")
    schema = StructType([*events.schema.fields, StructField("provider", IntegerType()), StructField("primary", IntegerType())])
    return ordered(rows.join(begun, keys), keys, *order).mapInArrow(replay, schema)
