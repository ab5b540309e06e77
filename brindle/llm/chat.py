"""Minimum-cost repair of chat roles: dynamic programming over an automaton of legal turns.

A legal sequence is an optional system turn, then user and assistant in turn, ending with assistant. Each turn
either begins a turn of the repaired sequence, under its own role or another, with empty turns before it where
the automaton asks for them, or merges into the turn before it. The cheapest repair is a path through the
automaton's states, so a run of turns is a small matrix of costs from state to state, and runs compose by
(min, +) products. Turns are range-partitioned by conversation and place, a partition's runs are packed into chunks,
and only the chunks' matrices meet: first those of a conversation in one partition, then those of
its partitions. They give each chunk the costs of reaching its first state; a chunk then tells for each state that it
may end in where the cheapest way begins, and these four numbers compose backwards. Even a conversation
with a third of all turns is spread over many tasks, and how it is cut changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, own_columns, small_batches, written

#: States: what the last turn so far was. A system turn comes first or not at all.
STATES = ("none", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Other names of the roles.
ALIASES = {"human": 2, "prompter": 2, "bot": 3, "gpt": 3, "model": 3, "ai": 3} | {s: k for k, s in enumerate(STATES) if k}
#: Turns and characters that a chunk holds at most (a longer turn is a chunk of its own).
CHUNK_TURNS, CHUNK_CHARACTERS = 1024, 2 << 20
INFINITE = float("inf")


@dataclass(frozen=True)
class Costs:
    """Costs of the repairs, and the marks of the rendered sequence.

    A known role is dearer to change than all merges and insertions that a turn can need (a merge, or three empty turns
    before it and two at the end): nobody's words become another's while there is another way.
    """

    merge: int = 2
    relabel: int = 24
    relabel_unknown: int = 1
    insert: int = 4
    begin: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    joint: str = "\n\n"


def role_of(role: str | None) -> int:
    """The state that a role names, 0 for none."""
    return ALIASES.get((role or "").strip().lower(), 0)


def _between() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns (user or assistant) to insert between a state and a next turn's role."""
    out = {}
    for s in NEXT:
        reach = [(s, ())]
        for path in reach:
            for t in NEXT[path[0]]:
                if (s, t) not in out:
                    out[s, t] = path[1]
                    if t != 1:
                        reach.append((t, (*path[1], t)))
    return out


#: (state, role) -> roles inserted; pairs that cannot be reached are missing.
BETWEEN = _between()
#: Empty turns to insert at a sequence's end.
AT_END = {s: () if s == 3 else (*BETWEEN[s, 3], 3) for s in range(4)}


def options(role: int, costs: Costs) -> list[tuple[float, int, int, bool]]:
    """(cost, state before, state after, merged) of all ways to take a turn; of equal costs the first is chosen."""
    change = lambda t: 0 if t == role else costs.relabel if role else costs.relabel_unknown
    out = [(len(path) * costs.insert + change(t), s, t, False) for (s, t), path in BETWEEN.items()]
    return sorted(out + [(costs.merge + change(s), s, s, True) for s in (1, 2, 3)])


def step(role: int, costs: Costs) -> np.ndarray:
    """Cost matrix of a turn."""
    m = np.full((4, 4), INFINITE)
    for cost, s, t, _ in options(role, costs):
        m[s, t] = min(m[s, t], cost)
    return m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(axis=1)


def begin() -> np.ndarray:
    """Costs of the states before the first turn."""
    return np.where(np.arange(4) == 0, 0.0, INFINITE)


def path(matrices: list[np.ndarray], row: np.ndarray, end: int) -> list[int]:
    """States before, between and after matrices on the cheapest way to `end`, given the costs of those before.

    From the end backwards, the smallest state where several are as cheap.
    """
    costs = [row]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    states = [end]
    for before, m in zip(costs[-2::-1], matrices[::-1], strict=True):
        states.append(int(np.argmin(before + m[:, states[-1]])))
    return states[::-1]


def repaired(roles: list[int], row: np.ndarray, end: int, costs: Costs) -> list[tuple[int, int, bool]]:
    """(state before, state after, merged) of each turn on the cheapest way to `end`."""
    kinds, ways = _tables(costs)
    states = path([kinds[r] for r in roles], row, end)
    return [ways[r, s, t] for r, s, t in zip(roles, states, states[1:], strict=False)]


@lru_cache(maxsize=16)
def _tables(costs: Costs) -> tuple[list[np.ndarray], dict[tuple[int, int, int], tuple[int, int, bool]]]:
    """Cost matrices by role, and the cheapest way by role, state before and state after."""
    ways: dict[tuple[int, int, int], tuple[int, int, bool]] = {}
    for r in range(4):
        for _, s, t, merged in options(r, costs):
            ways.setdefault((r, s, t), (s, t, merged))
    return [step(r, costs) for r in range(4)], ways


def best_end(row: np.ndarray, costs: Costs) -> int:
    """The state in which a whole sequence's cheapest repair ends, given the costs of reaching each."""
    return int(np.argmin(row + np.array([len(AT_END[s]) * costs.insert for s in range(4)])))


def rendered(before: int, after: int, merged: bool, text: str, last: bool, costs: Costs) -> str:
    """A turn's part of the repaired sequence; the parts in order make the whole."""
    if merged:
        out = costs.joint + text
    else:
        empty = "".join(costs.begin.format(role=STATES[t]) + costs.end for t in BETWEEN[before, after])
        out = (costs.end if before else "") + empty + costs.begin.format(role=STATES[after]) + text
    if last:
        out += costs.end + "".join(costs.begin.format(role=STATES[t]) + costs.end for t in AT_END[after])
    return out


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.reshape(x, (4, 4)) for x in pdf["m"]]


def _forward(row: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Costs of the states before, between and after matrices."""
    rows = [row]
    for m in matrices:
        rows.append((rows[-1][:, None] + m).min(axis=0))
    return rows


def _back(end: int, ways) -> list[int]:
    """The state after each of some runs, last run first, and the state before the first."""
    states = [end]
    for way in ways:
        states.append(int(way[states[-1]]))
    return states


def repair(turns: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repair and render all conversations, a row for each turn, repeated rows included.

    Returns conv_id, turn, place (their order in the conversation), role (as given), new_role, action (keep, relabel,
    merge, merge-relabel), inserted (empty turns before it), inserted_after (at the end), part (the rendered text; a
    conversation's parts in order of place make the whole). Turns go by turn, then role, then a hash of the text;
    null turns come first. Null texts are empty, null and unknown roles are the cheapest to relabel, rows with
    a null conversation are one conversation. No turn gives no row.
    """
    spark = turns.sparkSession
    small_batches(spark)
    kinds = dict(turns.dtypes)
    turns = own_columns(turns, conv_id=conv, turn=turn, role=role, text=text)
    order = ["conv_id", "turn", "role", "h", "salt"]
    turns = turns.withColumns({"h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    turns = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    turns = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("p"))

    def packed(batches) -> Iterator[list]:
        held: list[tuple] = []
        size, block, now = 0, 0, None
        opening = True  # the partition's first conversation may have begun before it
        begun = True  # the chunk begins its conversation

        def chunk(whole: bool) -> list:
            m = None
            for r in held:
                one = _tables(costs)[0][role_of(r[1])]
                m = one if m is None else product(m, one)
            turns_, roles_, texts_ = zip(*held, strict=True)
            return [[now[0]], [now[1]], [block], [whole], [list(turns_)], [list(roles_)], [list(texts_)], [m.ravel().tolist()]]

        for batch in batches:
            for c, t, r, x, p in zip(*[k.to_pylist() for k in batch.columns], strict=True):
                if held and (c != now[0] or len(held) >= CHUNK_TURNS or size + len(x) > CHUNK_CHARACTERS):
                    other = c != now[0]
                    yield chunk(other and begun and not opening)
                    held, size, block, begun = [], 0, block + 1, other
                    opening = opening and not other
                now = (c, p)
                held.append((t, r, x))
                size += len(x)
        if held:  # the partition's last conversation may go on after it
            yield chunk(False)

    a, b = kinds[conv], kinds[turn]
    chunks = written(mapped(turns, packed, f"conv_id {a}, p int, block int, whole boolean, turns array<{b}>, roles array<string>, texts array<string>, m array<double>"), "chunks")

    # Most conversations are one chunk, known to be whole, and are repaired where they lie. Of the others,
    # the chunks of a conversation in a partition, then the conversation's partitions: both are few for a group.
    key = f"conv_id {a}, p int"
    cut = chunks.where("not whole")
    small = cut.select("conv_id", "p", "block", "m")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = _matrices(pdf.sort_values("block"))
        for m in ms[1:]:
            ms[0] = product(ms[0], m)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "p": pdf["p"].iloc[:1], "m": [ms[0].ravel().tolist()]})

    def reached(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        rows = _forward(begin(), _matrices(pdf))
        return pd.DataFrame({"c": pdf["conv_id"], "q": pdf["p"], "row": rows[:-1]})

    spans = small.groupBy("conv_id", "p").applyInPandas(composed, f"{key}, m array<double>")
    spans = written(spans.groupBy("conv_id").applyInPandas(reached, f"c {a}, q int, row array<double>"), "spans")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") == F.col("q"))

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rows = _forward(np.array(pdf["row"].iloc[0]), _matrices(pdf))
        return pd.DataFrame({"p": pdf["p"], "block": pdf["block"], "row": rows[:-1], "after": rows[1:]})

    rows = small.join(spans, same).select("conv_id", "p", "block", "m", "row").groupBy("conv_id", "p")
    # blocks are numbered through a partition, so (p, block) names a chunk
    rows = written(rows.applyInPandas(entered, "p int, block int, row array<double>, after array<double>"), "entered")

    def backward(batches) -> Iterator[list]:
        for batch in batches:
            some = batch.to_pylist()
            ways = []
            for c in some:
                ms = [_tables(costs)[0][role_of(r)] for r in c["roles"]]
                ways.append([path(ms, np.array(c["row"]), end)[0] for end in range(4)])
            yield [[c[k] for c in some] for k in ("conv_id", "p", "block")] + [ways, [c["after"] for c in some]]

    ways = cut.select("conv_id", "p", "block", "roles").join(rows, ["p", "block"]).select("conv_id", "p", "block", "roles", "row", "after")
    ways = written(mapped(ways, backward, f"{key}, block int, way array<int>, after array<double>"), "ways")

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "p": pdf["p"].iloc[:1], "way": [[_back(e, pdf["way"])[-1] for e in range(4)]], "after": [pdf["after"].iloc[0]]})

    def ended(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ascending=False)
        ends = _back(best_end(np.array(pdf["after"].iloc[0]), costs), pdf["way"])
        return pd.DataFrame({"c": pdf["conv_id"], "q": pdf["p"], "t": ends[:-1], "final": [True] + [False] * (len(pdf) - 1)})

    ends = ways.groupBy("conv_id", "p").applyInPandas(through, f"{key}, way array<int>, after array<double>")
    ends = written(ends.groupBy("conv_id").applyInPandas(ended, f"c {a}, q int, t int, final boolean"), "ends")

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False)
        ends = _back(int(pdf["t"].iloc[0]), pdf["way"])
        return pd.DataFrame({"p": pdf["p"], "block": pdf["block"], "t": ends[:-1], "last": [bool(pdf["final"].iloc[0])] + [False] * (len(pdf) - 1)})

    states = ways.join(ends, same).select("conv_id", "p", "block", "way", "t", "final").groupBy("conv_id", "p").applyInPandas(left, "p int, block int, t int, last boolean")
    states = states.join(rows.select("p", "block", "row"), ["p", "block"])
    single = [F.lit(None).cast(t).alias(n) for n, t in (("row", "array<double>"), ("t", "int"), ("last", "boolean"))]
    columns = ["conv_id", "p", "block", "turns", "roles", "texts"]
    every = cut.join(states, ["p", "block"]).select(*columns, "row", "t", "last").unionByName(chunks.where("whole").select(*columns, *single))

    def told(batches) -> Iterator[list]:
        kinds, _ = _tables(costs)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for c in batch.to_pylist():
                roles = [role_of(r) for r in c["roles"]]
                row, end, final = c["row"], c["t"], c["last"]
                if row is None:  # a whole conversation
                    row, final = begin(), True
                    end = best_end(_forward(row, [kinds[r] for r in roles])[-1], costs)
                steps = repaired(roles, np.array(row), end, costs)
                for k, ((s, t, merged), number, given, text) in enumerate(zip(steps, c["turns"], c["roles"], c["texts"], strict=True)):
                    last = final and k == len(steps) - 1
                    same = role_of(given) == t
                    action = ("merge" if same else "merge-relabel") if merged else "keep" if same else "relabel"
                    place = (c["p"] << 40) + (c["block"] << 16) + k
                    row = (c["conv_id"], number, place, given, STATES[t], action, 0 if merged else len(BETWEEN[s, t]), len(AT_END[t]) if last else 0, rendered(s, t, merged, text, last, costs))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield out

    return mapped(every, told, f"conv_id {a}, turn {b}, place bigint, role string, new_role string, action string, inserted int, inserted_after int, part string")


def brute_force(turns: list[tuple[str | None, str]], costs: Costs = Costs()) -> tuple[float, str]:
    """Cost and text of one conversation's repair, for checks."""
    roles = [role_of(r) for r, _ in turns]
    row = _forward(begin(), [step(r, costs) for r in roles])[-1]
    end = best_end(row, costs)
    steps = repaired(roles, begin(), end, costs)
    text = "".join(rendered(*s, x, k == len(steps) - 1, costs) for k, (s, (_, x)) in enumerate(zip(steps, turns, strict=True)))
    return float(row[end] + len(AT_END[end]) * costs.insert), text
