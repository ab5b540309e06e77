"""Golden values and properties of addresses and texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import bits, text, vectors
from brindle.operators import signatures

QUANTUM = "b88301c8a631056d0405a53201a182e9123a02aa0f424c1231d4153c32115063"
BIOLOGY = "a88f0798e63103270c438d30209380c992380ace0d44cc1221041f0c23995843"
MODEL = "01ce1e21342a0743d4e2ad388e504af7ad8c00bae841240192d5c82127d1a564"


def hexed(limbs):
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in reversed(limbs))


def test_golden_addresses():
    assert hexed(bits.address_of("quantum")) == QUANTUM
    assert hexed(bits.address_of("quantum biology")) == BIOLOGY
    assert hexed(bits.address_of("Quantum  BIOLOGY")) == BIOLOGY
    assert hexed(bits.address_of("business model")) == MODEL
    assert bits.address_of("quantum") == [3590518151203344483, 1313365170755619858, 289819385229574889, -5151271587488397971]
    assert bits.address_of("") == bits.address_of("  ") == bits.address_of(None) == [0, 0, 0, 0]


def test_widths():
    base = bits.address_of("quantum biology")
    assert bits.address_of("quantum biology", 1024) == base * 4
    assert bits.address_of("quantum biology", 128) == base[:2]


def test_declarative_and_kernel_agree(spark):
    texts = ["quantum", "quantum biology", "Quantum  BIOLOGY", "business model", "", "  ", None, "a a a b", "été 中文 x y", "İI ΑΣ", "w " * 500 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {i: tuple(bits.address_of(t)) for i, t in enumerate(texts)}
    for kernel in (signatures.simhash, signatures.simhash_arrow):
        assert {r[0]: tuple(r[1:]) for r in kernel(df).collect()} == want


def test_resized_and_hex(spark):
    df = signatures.simhash(spark.createDataFrame([("a", "quantum biology")], "id string, text string"))
    row = df.select(bits.to_hex(bits.limbs_of()).alias("h"), bits.to_hex(bits.resized(bits.limbs_of(), 512)).alias("w"), *[c.alias(f"n{k}") for k, c in enumerate(bits.resized(bits.limbs_of(), 100))]).first()
    assert row["h"] == BIOLOGY and row["w"] == BIOLOGY * 2
    value = int(BIOLOGY, 16) & (1 << 100) - 1
    assert (row["n0"] & (1 << 64) - 1) + (row["n1"] << 64) == value


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc XYZé", max_size=12), max_size=5))
def test_order_of_words_does_not_matter(words):
    assert bits.address_of(" ".join(words)) == bits.address_of(" ".join(reversed(words)))


def test_tokens(spark):
    cases = {"a b\u0085c d e\u001cf": list("abcdef"), "a​b ᠎c ﻿d": ["a​b", "᠎c", "﻿d"], "İI ΑΣ": ["i̇i", "ας"], "  ": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.tokens(F.col("t")).alias("w"))
    assert {r["t"]: r["w"] for r in df.collect()} == cases
    for k, v in cases.items():
        assert k.lower().split() == v


def test_node_text(spark):
    row = ("", "label", None, "d" * 120, "x", "", "f" * 100)
    df = spark.createDataFrame([row], "a string, b string, c string, d string, e string, f string, g string")
    got = df.select(text.node_text(*[F.col(c) for c in "abcdefg"]).alias("t")).first()["t"]
    assert got == " ".join(["label", "d" * 100, "x", "f" * 80])


def test_bind_is_its_own_inverse(spark):
    df = spark.createDataFrame([(1, -5, 7, 1 << 62, 3, 9, -1, -(1 << 63))], "l0 long, l1 long, l2 long, l3 long, k0 long, k1 long, k2 long, k3 long")
    a, k = bits.limbs_of(), [F.col(f"k{j}") for j in range(4)]
    back = bits.unbind(bits.bind(a, k), k)
    assert df.select(bits.hamming(back, a).alias("d"), bits.hamming(a, a).alias("z")).first() == (0, 0)


def test_normalised(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
