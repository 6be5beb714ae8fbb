"""Stored rules over predicates: every distinct predicate once a batch of rows, then conditions over their bits.

Rules are data: a plan is the same for ten rules and for thousands. Classifiers stay expressions of the JVM, as there are a
dozen; words of all rules are sought by one automaton, and patterns, addresses, sizes and types are tested where the text is
read, in Arrow batches. A condition is evaluated over bit vectors, one for each predicate.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matching import kept_machine, machine_of

#: Rows whose predicates are held at a time.
ROWS = 512
FALSE = ("or", [])


@dataclass(frozen=True)
class RuleTable:
    """Predicates and conditions of rules. A condition is ("leaf", number), ("not", c), ("and" or "or", [c, ...])."""

    leaves: list[dict]
    conditions: list[tuple]
    flags: list[int]

    @property
    def words(self) -> list[str]:
        return sorted({w for x in self.leaves if x["match"] == "keywords" for w in x["words"]})


class _Evaluator:
    """What a worker makes of a table once: compiled patterns, sets and the automaton of all words."""

    def __init__(self, table: RuleTable):
        try:
            import regex as engine
        except ImportError:
            import re as engine
        self.table, words = table, table.words
        self.machine = machine_of(words) if words else None
        number = {w: k for k, w in enumerate(words)}
        self.words = {i: np.array([number[w] for w in x["words"]], np.int64) for i, x in enumerate(table.leaves) if x["match"] == "keywords"}
        self.patterns = {i: [engine.compile(p) for p in x["patterns"]] for i, x in enumerate(table.leaves) if x["match"] == "patterns"}
        self.sets = {i: frozenset(x["values"]) for i, x in enumerate(table.leaves) if "values" in x}
        self.n_words = len(words)

    def bits(self, texts: list, flags: list, plain: dict[str, list]) -> list[np.ndarray]:
        """A bit vector of every predicate; those of texts that are null are false."""
        n, out = len(texts), []
        held = np.zeros((n, self.n_words), bool)
        if self.machine is not None:
            for i, t in enumerate(texts):
                if t is not None:
                    held[i, [k for _, k in self.machine.iter(t.lower())]] = True
        known = np.array([f if f is not None else [False] * len(self.table.flags) for f in flags], bool).reshape(n, len(self.table.flags))
        place = {leaf: k for k, leaf in enumerate(self.table.flags)}
        for i, x in enumerate(self.table.leaves):
            kind = x["match"]
            if i in place:
                out.append(known[:, place[i]])
            elif kind == "keywords":
                out.append(held[:, self.words[i]].sum(1) >= x["min"])
            elif kind == "patterns":
                out.append(np.array([t is not None and any(p.search(t) for p in self.patterns[i]) for t in texts], bool))
            elif kind == "size":
                out.append(np.array([v is not None and v >= x["at_least"] for v in plain["size"]], bool))
            elif kind == "sender":
                out.append(np.array([v in self.sets[i] for v in plain["sender"]], bool))
            else:
                out.append(np.array([v is not None and not self.sets[i].isdisjoint(v) for v in plain[kind]], bool))
        return out

    def holds(self, condition: tuple, bits: list[np.ndarray], n: int) -> np.ndarray:
        kind, inner = condition
        if kind == "leaf":
            return bits[inner]
        if kind == "not":
            return ~self.holds(inner, bits, n)
        parts = [self.holds(x, bits, n) for x in inner]
        if not parts:
            return np.zeros(n, bool)
        return np.logical_and.reduce(parts) if kind == "and" else np.logical_or.reduce(parts)


def rules_that_hold(spark, table: RuleTable, raw: Column, decoded: Column, flags: Column, decoded_flags: Column, plain: dict[str, Column]) -> Column:
    """Numbers of the rules whose condition holds on the raw text or, where there is one, on the decoded text.

    Flags must be columns that the optimizer can't replace by what they are made of: Spark finds no Python function that has
    nested lambdas in its arguments. Where there is no decoded text, ``decoded_flags`` is null.
    """
    sent, name, kinds = spark.sparkContext.broadcast(pickle.dumps(table)), uuid.uuid4().hex, list(plain)

    def find(given: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = kept_machine(name, lambda: _Evaluator(pickle.loads(sent.value)))
        for batch in given:
            found = []
            for at in range(0, len(batch[0]), ROWS):
                texts, other, f, g, some, *values = (c.slice(at, ROWS).to_pylist() for c in batch)
                values, n = dict(zip(kinds, values, strict=True)), len(texts)
                bits = own.bits(texts, f, values)
                second = own.bits(other, g, values) if any(some) else None
                also, hit = np.array(some, bool), np.zeros((len(own.table.conditions), n), bool)
                for k, c in enumerate(own.table.conditions):
                    hit[k] = own.holds(c, bits, n)
                    if second is not None:
                        hit[k] |= also & own.holds(c, second, n)
                found += [np.flatnonzero(hit[:, i]).tolist() for i in range(n)]
            yield pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(find, "array<int>")(raw, decoded, flags, decoded_flags, decoded_flags.isNotNull(), *plain.values())
