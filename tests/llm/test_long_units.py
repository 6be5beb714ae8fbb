"""op6 with units of more ids or characters than 16 or 20 bits hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import piece_lattice


@pytest.fixture(scope="module")
def model(spark):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spark.sparkContext.broadcast(piece_lattice.load(f.read()))


def test_long_unit_keeps_its_ids_and_those_after_it(spark, model):
    a, b, c = (model.value.ids[x] for x in "abc")
    long = "a" * 70_000
    coded = spark.createDataFrame([("b", [b]), (long, [a] * len(long)), ("c", [c]), ("bc", [b, c])], "unit string, ids array<int>").coalesce(1)
    known = piece_lattice.Known.of(coded)
    got = [np.frombuffer(x, np.uint16).tolist() for x in known.find(["b", long, "c", "bc"])]
    assert got == [[b], [a] * len(long), [c], [b, c]]


def test_edges_beyond_twenty_bits(spark, model):
    a, at = model.value.ids["a"], (1 << 20) + 5
    rows = spark.createDataFrame([(at, 1), (at + 1, 1)], "s int, l int").select((piece_lattice.packed(F.col("s"), F.col("l")) + a).alias("edge"))
    edges = rows.groupBy(F.lit(7).cast("long").alias("uid")).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    got = [(x.s, x.e, x.pid) for x in piece_lattice._transitions(edges, model).first().edges]
    assert got == [(at, at + 1, a), (at + 1, at + 2, a)]
    assert model.value.longest <= piece_lattice.LONGEST
