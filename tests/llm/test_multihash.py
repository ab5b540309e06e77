import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import multihash
from brindle.llm.multihash import added, alike, edited_fingerprints, fingerprints, likeness, read, shown, summed, taken, vectors


def slow(text):
    """A text's lanes and counters, a window after the other."""
    lanes, counters = [0] * 4, [0] * 256
    for line in text.split(b"\n"):
        digest = hashlib.sha256(line).digest()
        for j in range(4):
            lanes[j] = (lanes[j] + int.from_bytes(digest[8 * j : 8 * j + 8], "little")) % 2**64
        for k in range(len(line)):
            if line[k]:
                h = int.from_bytes(line[k : k + 8].ljust(8, b"\0"), "little") * 0x9E3779B97F4A7C15 % 2**64
                h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
                place = (h >> 40) % 512
                counters[place // 2] = (counters[place // 2] + (-1 if place % 2 else 1)) % 2**32
    return lanes, counters


def of(*texts):
    return shown(*vectors([t.encode() for t in texts]))


def test_vectors_against_a_window_after_the_other(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "\n", "ab\n\ncd", "äöü…" * 9, *["".join(rng.choice("abc \n\0é") for _ in range(rng.randrange(400))) for _ in range(20)]]
    for block in (1 << 20, 64):  # in one block, and in many
        monkeypatch.setattr(multihash, "BLOCK", block)
        lanes, counters = vectors([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert (lanes[k].tolist(), counters[k].tolist()) == slow(t.encode())


def test_paragraphs_are_a_multiset():
    a, b, c, d = of("one\ntwo two\nthree", "three\none\ntwo two", "one\ntwo two\nthree\nthree", "one\ntwo two")
    assert a == b and len({a, c, d}) == 3
    assert of("ab") != of("a\nb") != of("b\na\n")


def test_insertion_and_deletion(spark):
    whole, part, rest = of("one\ntwo\nthree", "one\nthree", "two")
    row = spark.createDataFrame([(whole, part, rest), (None, part, None)], "a string, b string, c string")
    got = row.select(added(F.col("b"), F.col("c")).alias("sum"), taken(F.col("a"), F.col("c")).alias("less"), likeness(F.col("a"), F.col("a")).alias("same")).collect()
    assert tuple(got[0]) == (whole, part, 1.0) and tuple(got[1]) == (None, None, None)


def test_likeness_follows_the_share_of_windows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(4000)]
    base = [rng.choice(words) for _ in range(600)]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        kept = int(600 * share)
        other = base[:kept] + [rng.choice(words) for _ in range(600 - kept)]
        got = alike(*(read(of(" ".join(t))) for t in (base, other)))[0]
        assert abs(got - share) < 0.2
    empty, some = read(of("")), read(of("x"))
    assert alike(empty, empty)[0] == 1.0 and alike(empty, some)[0] == 0.0


def test_sums_of_groups(spark):
    texts = [(k, f"g{k % 3}" if k % 5 else None, f"line {k}\nshared") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, g string, text string").repartition(4)
    prints = fingerprints(docs).join(docs.select(F.col("doc_id").alias("id"), "g"), "id")
    got = {r["g"]: (r["fingerprint"], r["rows"]) for r in summed(prints, "g").collect()}
    for g in {t[1] for t in texts}:
        mine = [t[2] for t in texts if t[1] == g]
        assert got[g] == (of("\n".join(mine))[0], len(mine))
    assert len(got) == 4 and summed(prints.where("false"), "g").count() == 0


def brute(rows, share=4):
    """Rows in order, each with the next: the whole result, every fingerprint from scratch."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ties = [r["t"] for r in spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k int, text string").select("k", F.xxhash64("text").alias("t")).orderBy("k").collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, ties[k]))
    out = []
    for at, k in enumerate(order):
        mine, after = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        n = len(mine) // share
        edited = mine[: len(mine) - n] + after[:n]
        a, b, c = of(mine, edited, after)
        near = [round(float(alike(read([a]), read([x]))[0]), 9) for x in (b, c)]
        out.append((rows[k][0], len(mine), hashlib.sha256(edited.encode()).hexdigest(), a, b, *near))
    return out


def same(df, want):
    got = [(*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_edited_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcd éß…\n") for _ in range(n))
    rows = [(k * 3 - 50, text(rng.randrange(200))) for k in range(300)]
    rows += [(None, "null id"), (None, "another"), (4, None), (4, None), (7, "tie"), (7, "other tie"), (10, "twice"), (10, "twice"), (900, "x" * 200_000 + "\nend"), (901, ""), (902, "\n\n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, part string, n_chars int").repartition(5)
    found = edited_fingerprints(docs)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same(found, brute(rows))


def test_edited_small_tables(spark):
    for rows in ([], [(1, "alone\nhere")], [(1, "abcdefgh"), (2, "x")], [(5, "same text")] * 7, [(None, None)]):
        same(edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")), brute(rows))


def test_string_ids(spark):
    rows = [(f"k{k}", f"text {k}\nof {k}") for k in range(40)]
    got = edited_fingerprints(spark.createDataFrame(rows, "name string, body string"), id_column="name", text_column="body").collect()
    ordered = sorted(rows)
    want = {i: t[: len(t) - len(t) // 4] + ordered[(k + 1) % 40][1][: len(t) // 4] for k, (i, t) in enumerate(ordered)}
    assert {r["name"]: r["edited_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_bytes_that_are_no_utf8():
    assert np.array_equal(vectors([b"\xff\xfe ok"])[0], vectors([b"\xff\xfe ok"])[0])
