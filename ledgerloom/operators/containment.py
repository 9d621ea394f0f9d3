"""Which of many strings each text contains: one automaton over all of them, so a text is scanned once however many there are."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of strings in one automaton, about; an automaton takes some 100 bytes a character in each worker. More are searched in slices, one scan of the texts each.
SLICE_CHARS = 500_000

_BUILT: dict[str, object] = {}


def _automaton(name: str, needles):
    """The automaton of a broadcast list, built once a worker; name is the list's own."""
    import ahocorasick

    if name not in _BUILT:
        built = ahocorasick.Automaton()
        for i, needle in enumerate(needles.value):
            built.add_word(needle, i)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[name] = built
    return _BUILT[name]


def _found(name: str, needles):
    def run(batches):
        automaton, names = _automaton(name, needles), needles.value
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = {i for _, i in automaton.iter(text)} if text else ()
                rows += [row] * len(own)
                hits += own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([names[i] for i in hits], pa.string())], ["doc_id", "needle"])

    return run


def contained(texts: DataFrame, needles: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, needle: each distinct needle that a text contains. texts: doc_id, text; needles: needle. Empty needles and null texts give nothing.

    The needles pass the driver slice by slice, each of bounded size; their number bounds how often the texts are read."""
    spark = texts.sparkSession
    own = needles.where("needle <> ''").select("needle").distinct()
    chars = own.agg(F.sum(F.length("needle"))).first()[0] or 0
    slices = max(1, -(-chars // slice_chars))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for i in range(slices):
        part = [r[0] for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(slices)) == i).collect()]
        if part:
            hits = texts.select("doc_id", "text").mapInArrow(_found(uuid.uuid4().hex, spark.sparkContext.broadcast(sorted(part))), f"doc_id {kind}, needle string")
            found = hits if found is None else found.unionByName(hits)
    return found if found is not None else texts.select("doc_id", F.lit("").alias("needle")).where("false")
