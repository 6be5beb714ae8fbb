"""Matching of many terms at once: one pass of an automaton over each text instead of a search a term.

The work stays a narrow map: Arrow batches go to Python workers, which return the numbers of the terms that
occur. A text of a few kilobytes against some hundred terms takes microseconds this way, and the JVM's generated
code stays small, where a chain of ``contains`` outgrows its limit of 64 KB and is then interpreted.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Terms of a block, each of which is one pass over the texts of :func:`terms_in`.
BLOCK_TERMS = 50_000
#: Automata that a worker keeps between tasks, newest last.
_kept: dict[str, object] = {}


def kept_machine(name: str, make):
    """A worker builds or loads an automaton once, not for every task; it keeps the two that it used last."""
    machine = _kept.pop(name, None) or make()
    _kept[name] = machine
    while len(_kept) > 2:
        del _kept[next(iter(_kept))]
    return machine


def machine_of(terms: list[str]):
    """An automaton that gives the numbers of the terms."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        machine.add_word(t, k)
    machine.make_automaton()
    return machine


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    block: list[str] = []
    for r in terms.where("term <> ''").select("term").distinct().toLocalIterator():
        block.append(r["term"])
        if len(block) == BLOCK_TERMS:
            yield block
            block = []
    if block:
        yield block


def terms_in(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, term: the terms (a table with a column term) that stand anywhere in a text, once each.

    The automaton of a block of terms is built and serialised once, broadcast and kept by the workers; nothing is shuffled.
    """
    spark = df.sparkSession
    schema = f"`{key}` {dict(df.dtypes)[key]}, term string"
    out = spark.createDataFrame([], schema)
    for block in _blocks(terms):
        out = out.union(_pass(df.select(key, F.col(text).alias("__text")), schema, spark.sparkContext.broadcast(pickle.dumps((machine_of(block), block)))))
    return out


def _pass(rows: DataFrame, schema: str, sent) -> DataFrame:
    name = uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, terms = kept_machine(name, lambda: pickle.loads(sent.value))
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    hits = sorted({k for _, k in machine.iter(text)})
                    at += [i] * len(hits)
                    found += [terms[k] for k in hits]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(found, pa.string())], names=[batch.schema.names[0], "term"])

    return rows.mapInArrow(find, schema)


def term_hits(forms: list[Column], terms: list[str]) -> Column:
    """For every form of a text, the numbers of the ``terms`` that occur in it, ascending; null for a null form."""
    distinct, name = list(dict.fromkeys(terms)), uuid.uuid4().hex

    def find(given: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        machine = kept_machine(name, lambda: machine_of(distinct))
        for batch in given:
            columns = [batch] if isinstance(batch, pa.Array) else batch
            rows = []
            for texts in zip(*(c.to_numpy(zero_copy_only=False) for c in columns), strict=True):
                known: dict[str, list[int]] = {}
                for t in texts:
                    if t is not None and t not in known:
                        known[t] = sorted({k for _, k in machine.iter(t)})
                rows.append([None if t is None else known[t] for t in texts])
            yield pa.array(rows, pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(find, "array<array<int>>")(*forms)


class Hits:
    """Questions about the result of :func:`term_hits` in column ``name``; ``forms`` are the places of the forms asked."""

    def __init__(self, name: str, terms: list[str], forms: list[int]):
        self.number = {t: k for k, t in enumerate(dict.fromkeys(terms))}
        parts = [F.coalesce(F.get(F.col(name), F.lit(f)), F.array().cast("array<int>")) for f in forms]
        self.found = parts[0] if len(parts) == 1 else F.array_union(*parts) if len(parts) == 2 else F.array_distinct(F.flatten(F.array(*parts)))

    def _numbers(self, terms: list[str]) -> Column:
        return T.array_of(sorted({self.number[t] for t in terms}))

    def any_of(self, terms: list[str]) -> Column:
        return F.arrays_overlap(self.found, self._numbers(terms))

    def count_of(self, terms: list[str]) -> Column:
        return F.size(F.array_intersect(self.found, self._numbers(terms)))

    def all_of(self, terms: list[str]) -> Column:
        """The terms that occur, in list order."""
        own = sorted(dict.fromkeys(terms), key=self.number.get)
        named = [self.number[t] for t in own]
        return F.transform(F.sort_array(F.array_intersect(self.found, self._numbers(own))), lambda k: F.get(T.array_of(own), F.array_position(T.array_of(named), k).cast("int") - 1))
