"""Models as plug-ins that are called for several rows at once.

A task gathers what it has to ask over its Arrow batches, calls the model for `size` inputs at a time, and gives each row
its part of the reply, so a task with n inputs makes ceil(n / size) calls whatever the batches are. The model is made once
for each task (weights are loaded there, never sent). Rows keep their order; rows that need no call pass through without
one and wait for at most `most_held` others.

Defined results: a model that fails, or gives fewer replies than inputs, leaves `missing` for the rows without one; further
replies are cut off; null inputs are handed on as None; an empty table makes no model and no call.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandloom.functions.text import embedding_text
from strandloom.operators import layout, replies

#: Texts of a call, for classifiers and for embedders; rows that wait for a call to fill, at most.
CLASSIFIED, EMBEDDED, MOST_HELD = 10, 32, 50_000
#: Characters of a text that a classifier is shown.
PREVIEW = 500

Model = Callable[[list[tuple]], list]


def called(df: DataFrame, model: Callable[[], Model], inputs: list[Column], kind: str, size: int, name: str = "reply", where: Column | None = None, missing=None, most_held: int = MOST_HELD) -> DataFrame:
    """`df` with the column `name` of type `kind`: the model's replies for the rows that meet `where`, null for others.
    `model()` gives a function from a list of tuples (one value of each input) to a list of replies."""
    asked = [f"_{name}_{k}" for k in range(len(inputs))]
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = df.select("*", *[c.alias(n) for c, n in zip(inputs, asked)], keep.alias(f"_{name}"))
    struct = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ask: Model | None = None
        waiting: deque[tuple[pa.RecordBatch, list]] = deque()  # a batch, its replies
        queue: deque[tuple[tuple, list, int]] = deque()  # an input, where its reply goes
        held = 0

        def call() -> None:
            nonlocal ask
            taken = [queue.popleft() for _ in range(min(size, len(queue)))]
            try:
                ask = ask or model()
                got = list(ask([x for x, _, _ in taken]))[: len(taken)]
            except Exception:  # a plug-in's failure is a missing reply, whatever it raises
                got = []
            got += [missing] * (len(taken) - len(got))
            for (_, into, k), value in zip(taken, got):
                into[k] = missing if value is None else value

        def ready(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            open_ = {id(into) for _, into, _ in queue}
            while waiting and (rest or id(waiting[0][1]) not in open_):
                batch, into = waiting.popleft()
                held -= batch.num_rows
                reply = pa.array(into, to_arrow_type(struct[name].dataType))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], reply], names=struct.names)

        for batch in batches:
            into: list = [None] * batch.num_rows
            values = [c.to_pylist() for c in batch.columns[width:-1]]
            for k, wanted in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if wanted:
                    queue.append((tuple(v[k] for v in values), into, k))
            waiting.append((batch, into))
            held += batch.num_rows
            while len(queue) >= size:
                call()
            if held > most_held and queue:
                call()
            yield from ready(False)
        while queue:
            call()
        yield from ready(True)

    return rows.mapInArrow(run, struct)


def texted(model: Callable[[], Callable[[list[tuple]], str]]) -> Callable[[], Model]:
    """A model that answers a whole batch with one text: each row gets the text, its place and the number of inputs."""

    def make() -> Model:
        ask = model()

        def run(inputs: list[tuple]) -> list:
            reply = ask(inputs)
            return [{"reply": reply, "place": k, "expected": len(inputs)} for k in range(len(inputs))]

        return run

    return make


def prompt(inputs: list[tuple]) -> str:
    """What a classifier is asked for a batch of (preview, context)."""
    lines = [f"[{k}] Context: {context}\nContent: {text}" if context else f"[{k}] {text}" for k, (text, context) in enumerate(inputs, 1)]
    return "Classify these chunks:\n\n" + "\n\n".join(lines)


def reclassified(df: DataFrame, kind: str, text: Column, model: Callable[[], Callable[[list[tuple]], str]], context: Column | None = None, variant: str = "function", least: float = 0.6, size: int = CLASSIFIED) -> DataFrame:
    """`df` with the section type in `kind` overridden, `confidence` and `overridden`. Only rows that the rules left general
    and whose text has a sign of a section (`layout.doubtful`) are asked, and only a sure reply of another type counts."""
    preview = F.btrim(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW), F.lit("\n"), F.lit(" ")))
    doubt = (F.col(kind) == "general") & layout.doubtful(F.coalesce(text, F.lit("")), variant)
    inputs = [preview, F.lit(None).cast("string") if context is None else context]
    rows = called(df, texted(model), inputs, "struct<reply:string,place:int,expected:int>", size, "_answer", doubt)
    answer = F.get(replies.sections_of(F.col("_answer.reply"), F.col("_answer.expected")), F.col("_answer.place"))
    rows = rows.withColumn("_section", F.when(F.col("_answer").isNotNull(), answer))
    counts = F.coalesce((F.col("_section.confidence") >= least) & (F.col("_section.section_type") != "general"), F.lit(False))
    out = rows.withColumns({kind: F.when(counts, F.col("_section.section_type")).otherwise(F.col(kind)), "confidence": F.col("_section.confidence"), "overridden": counts})
    return out.drop("_answer", "_section")


def embedded(df: DataFrame, text: Column, model: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "vector", prefix: str = "", size: int = EMBEDDED) -> DataFrame:
    """`df` with a vector of each text: new lines as spaces, after the prefix that a model wants for questions. A text whose
    vector is missing has none."""

    def make() -> Model:
        ask = model()
        return lambda inputs: [None if v is None else list(map(float, v)) for v in ask([t for (t,) in inputs])]

    return called(df, make, [embedding_text(text, prefix)], "array<double>", size, name)
