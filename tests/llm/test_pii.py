"""Base spans against the plain patterns, disclosure against counts by hand."""

import hashlib
import math
import random
import re

import pytest

from brindle.llm import pii
from brindle.llm.common import written

SCHEMA = "doc_id long, text string, row string, spans int, term string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_at_random():
    r = random.Random(6)
    signs = list("ab@@..-+ 0123456789 ()%é@.com1.2.3.4.")
    for _ in range(30_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_are_read_once():
    for text in ("1" * 300_000, "1." * 100_000, "a@" * 100_000, "@a." * 50_000, "+1" * 100_000, "a.-" * 100_000 + "@"):
        pii.base_spans(text)


def test_digests(spark):
    rows = [(1, "a.b@c.de und 1.2.3.4, +49 30 1234567 4111 1111 1111 1111"), (2, None), (3, ""), (3, ""), (4, "é@x.y ä@ü.de 256.1.1.1 x@y"), (5, "z " * 200_000 + "q@r.st")]
    got = {x["doc_id"]: x for x in pii.digests(pii.sanitised_spans(frame(spark, rows))).collect()}
    for i, t in rows:
        spans = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["spans"] == joined
    assert pii.digests(pii.sanitised_spans(frame(spark, rows))).count() == len(rows)
    assert pii.sanitised_spans(frame(spark, [])).collect() == []


def disclosing_rows():
    """Word `zorblat` stands only beside one address; `common` is everywhere."""
    rows = [(k, f"common text {k} here Zorblat writes ann@mail.example.com today common number {k}") for k in range(4)]
    return rows + [(10 + k, f"common words {k} without anybody, today as well") for k in range(30)]


def test_terms_that_disclose(spark):
    rows = disclosing_rows()
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in pii.sanitised_spans(frame(spark, rows)).collect()}
    for i, text in rows:
        at = text.find("Zorblat")
        assert (("remove", at, at + 7) in got[i]) == (at >= 0)
        assert not any(k in ("remove", "generalise") and text[a:b].lower() in ("common", "today") for k, a, b in got[i])
        assert (at >= 0) == any(k == "email" for k, _, _ in got[i])


def test_sanitised_texts(spark):
    rows = disclosing_rows() + [(99, None), (98, "")]
    df = frame(spark, rows)
    got = {x["doc_id"]: x for x in pii.sanitised(df).collect()}
    assert pii.sanitised(df).columns == df.columns and len(got) == len(rows)
    assert "[EMAIL]" in got[0]["text"] and "Zorblat" not in got[0]["text"] and "example.com" not in got[0]["text"]
    assert all(got[i]["text"] == t for i, t in rows if t is None or "@" not in t)


def test_terms_far_from_the_entity(spark):
    """A term that stands far from the address in every text is marked at all its places, beside a common filler."""
    filler = "common words " * 60
    rows = [(k, f"Zorblat {filler} number{k} writes ann@mail.example.com {filler} and zorblat, {filler}é zorblat") for k in range(4)]
    rows += [(10 + k, f"{filler} writes number and é {k}") for k in range(30)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in pii.sanitised_spans(frame(spark, rows)).collect()}
    for i, text in rows:
        want = [("remove", m.start(), m.end()) for m in re.finditer("(?i)zorblat", text)]
        assert [s for s in got[i] if s[0] in ("remove", "generalise")] == want
        assert len(want) == (3 if i < 10 else 0)


def disclosed(rows, thresholds=pii.Thresholds()):
    """Pairs and their disclosure by counting over whole texts."""
    spans = [pii.base_spans(t) for _, t in rows]
    words = [{m[0].lower() for m in pii.WORD.finditer(t)} for _, t in rows]
    own = [{m[0].lower() for m in pii.WORD.finditer(t) if not any(a < m.end() and m.start() < b for a, b, _ in s)} for (_, t), s in zip(rows, spans, strict=True)]
    held, out = [{pii.entity(t, x) for x in s} for (_, t), s in zip(rows, spans, strict=True)], {}
    for e in set().union(*held):
        at = [k for k, h in enumerate(held) if e in h]
        for w in set().union(*[own[k] for k in at]):
            both, n = sum(w in own[k] for k in at), sum(w in x for x in words)
            if both >= thresholds.support and len(at) < len(rows):
                share = math.log(len(rows) * both / (len(at) * max(n, both))) / math.log(len(rows) / len(at))
                if share >= thresholds.generalise:
                    out[e, w] = round(share, 9)
    return out


@pytest.mark.parametrize("sent", [200_000, 0])
def test_counts_at_random(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "SENT_TERMS", sent)
    monkeypatch.setattr(pii, "HELD_PAIRS", 40)
    r = random.Random(8)
    rows = []
    for k in range(120):
        who = r.randrange(12)
        words = [f"w{int(40 * r.random() ** 2)}" for _ in range(30)] + [f"own{who}"] * (r.random() < 0.8)
        r.shuffle(words)
        rows.append((k, " ".join(words + [f"p{who}@mail.org"] * (who < 6))))
    df = frame(spark, rows)
    found = written(pii.detect(df), "found")
    got = {(x["entity"], x["term"]): round(x["disclosure"], 9) for x in pii.disclosing(df, found).collect()}
    assert got == disclosed(rows) and got


def test_a_directory_costs_its_words(spark):
    """Entities of the same rows are counted once for all, and tell what each of them tells."""
    names = [f"p{k}@mail.org" for k in range(300)]
    rows = [(k, " ".join([f"word{j} {a}" for j, a in enumerate(names)] + [f"copy{k}"])) for k in range(3)]
    rows += [(10, f"{names[0]} word1"), *((20 + k, f"plain text {k} word1") for k in range(30))]
    df = frame(spark, rows)
    found = written(pii.detect(df), "found")
    few = pii.disclosing(df, found, each_entity=False).collect()
    assert len({x["entity"] for x in few}) <= 2 and len(few) <= 600
    got = {(x["entity"], x["term"]): round(x["disclosure"], 9) for x in pii.disclosing(df, found).collect()}
    assert got == disclosed(rows) and len(got) > 80_000
    spans = {x["doc_id"]: [s for s in x["spans"] if s["kind"] == "remove"] for x in pii.sanitised_spans(df).collect()}
    assert len(spans[0]) == 299 and not spans[20]


def test_replacing():
    assert pii.sanitise("abc Def 12", [(0, 3, "remove"), (4, 7, "generalise"), (8, 10, "generalise")]) == " [NAME] [NUMBER]"
    assert pii.sanitise("0123456789", [(0, 5, "card"), (3, 7, "phone")]) == "[CARD]789"
