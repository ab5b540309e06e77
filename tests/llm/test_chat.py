"""Repairs against a search over all of them, whole and in chunks."""

import random
from collections import defaultdict

import pytest

from brindle.llm import chat

COSTS = chat.Costs()
SCHEMA = "conv_id long, turn long, role string, text string, p int, block string, m string"


def cheapest(roles):
    best = [10**9]

    def go(k, state, cost):
        if cost >= best[0]:
            return
        if k == len(roles):
            best[0] = min(best[0], cost + len(chat.AT_END[state]) * COSTS.insert)
            return
        r = roles[k]
        change = lambda t: 0 if t == r else COSTS.relabel if r else COSTS.relabel_unknown
        if state:
            go(k + 1, state, cost + COSTS.merge + change(state))

        def begin(s, c, inserted):
            for t in chat.NEXT[s]:
                go(k + 1, t, c + change(t))
                if inserted < 3 and t != 1:
                    begin(t, c + COSTS.insert, inserted + 1)

        begin(state, cost, 0)

    go(0, 0, 0)
    return best[0]


def test_cost_is_least():
    r = random.Random(1)
    for _ in range(250):
        roles = [r.randrange(4) for _ in range(r.randint(1, 5))]
        cost, _ = chat.brute_force([(chat.STATES[x] if x else "narrator", "t") for x in roles])
        assert cost == cheapest(roles)


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "y", "z") for c, t, r, x in rows], SCHEMA).repartition(3)


def whole(rows):
    by = defaultdict(list)
    for x in rows:
        by[x["conv_id"]].append(x)
    return {c: "".join(x["part"] for x in sorted(some, key=lambda x: x["place"])) for c, some in by.items()}


@pytest.mark.parametrize("turns", [1024, 3])
def test_chunks_make_the_same_text(spark, monkeypatch, turns):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "Human", "gpt", None, "tool"]), f"{c}/{t}") for c in range(30) for t in range(r.randint(1, 12))]
    rows += [(77, t, r.choice(["user", "user", "assistant"]), f"h{t}") for t in range(400)]  # one conversation with most turns
    monkeypatch.setattr(chat, "CHUNK_TURNS", turns)
    found = chat.repair(frame(spark, rows)).collect()
    by = defaultdict(list)
    for c, t, role, x in sorted(rows):
        by[c].append((role, x))
    assert whole(found) == {c: chat.brute_force(some)[1] for c, some in by.items()} and len(found) == len(rows)


def test_actions(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (3, 0, "user", "q")]
    got = {(x["conv_id"], x["turn"]): (x["new_role"], x["action"], x["inserted"], x["inserted_after"]) for x in chat.repair(frame(spark, rows)).collect()}
    assert got[1, 0] == ("user", "keep", 0, 0) and got[1, 1] == ("user", "merge", 0, 0) and got[1, 2] == ("assistant", "keep", 0, 0)
    assert got[2, 0] == ("assistant", "keep", 1, 0) and got[3, 0] == ("user", "keep", 0, 1)
    assert "".join(sorted(x["part"] for x in chat.repair(frame(spark, rows[:3])).orderBy("place").collect())) != ""


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x" * 3_000_000), (5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", "t")]
    found = chat.repair(frame(spark, rows)).collect()
    assert len(found) == 5
    texts = whole(found)
    assert texts[5] == chat.brute_force([("assistant", "t"), ("user", "same"), ("user", "same")])[1]
    assert texts[None] == chat.brute_force([(None, ""), ("user", "x" * 3_000_000)])[1]
    assert chat.repair(frame(spark, [])).collect() == []


def told(turns):
    """The cheapest repair's text by trying all repairs, with a renderer of its own: whole turns are joined, then written."""
    best = [None]

    def go(k, sequence, cost):
        if best[0] is not None and cost > best[0][0]:
            return
        if k == len(turns):
            state, tail = (sequence[-1][0] if sequence else 0), []
            while state != 3:
                state = {0: 2, 1: 2, 2: 3}[state]
                tail.append((state, [""]))
            cost += COSTS.insert * len(tail)
            if best[0] is None or cost < best[0][0]:
                best[0] = (cost, set())
            if cost == best[0][0]:
                best[0][1].add("".join(f"<|{chat.STATES[r]}|>\n" + "\n\n".join(parts) + "<|end|>\n" for r, parts in sequence + tail))
            return
        role, text = chat.role_of(turns[k][0]), turns[k][1]
        change = lambda t: 0 if t == role else COSTS.relabel if role else COSTS.relabel_unknown
        if sequence:
            last, parts = sequence[-1]
            go(k + 1, sequence[:-1] + [(last, parts + [text])], cost + COSTS.merge + change(last))

        def begin(state, empties):
            for t in {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[state]:
                go(k + 1, sequence + empties + [(t, [text])], cost + COSTS.insert * len(empties) + change(t))
                if t != 1 and len(empties) < 2:
                    begin(t, empties + [(t, [""])])

        begin(sequence[-1][0] if sequence else 0, [])

    go(0, [], 0)
    return best[0]


def test_text_is_that_of_a_cheapest_repair():
    r = random.Random(9)
    for _ in range(150):
        turns = [(r.choice(["user", "assistant", "system", "Human", "gpt", None, "tool"]), f"t{k}") for k in range(r.randint(1, 5))]
        cost, text = chat.brute_force(turns)
        least, texts = told(turns)
        assert cost == least and text in texts


def test_words_stay_with_their_role(spark):
    """No user's or assistant's words become another's while merges and empty turns can repair the conversation."""
    rows = [(1, 0, "user", "Q1"), (1, 1, "user", "Q2"), (2, 0, "assistant", "Hi"), (2, 1, "user", "Q"), (2, 2, "assistant", "A"), (3, 0, "user", "Q"), (3, 1, "assistant", "A"), (3, 2, "assistant", "B")]
    got = {(x["conv_id"], x["turn"]): (x["new_role"], x["action"]) for x in chat.repair(frame(spark, rows)).collect()}
    assert all(got[c, t][0] == role for c, t, role, _ in rows)
    assert got[1, 1] == ("user", "merge") and got[3, 2] == ("assistant", "merge")
    r = random.Random(3)
    for _ in range(300):
        roles = [r.choice((2, 3)) for _ in range(r.randint(1, 12))]
        end = chat.best_end(chat._forward(chat.begin(), [chat.step(x, COSTS) for x in roles])[-1], COSTS)
        assert [t for _, t, _ in chat.repaired(roles, chat.begin(), end, COSTS)] == roles
