"""Chat formatting: the roles of a conversation are repaired at least cost, then it is rendered.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last. The automaton's
state is the role written last. Each turn is kept, relabelled, or merged into the turn before, and empty turns may be
inserted before it or at the end; ``COSTS`` says what that costs. What one turn may do depends on its role alone, so a
turn is one of four fixed tables of costs from state to state, and a run of turns is their min-plus product.

Turns are ranged by (conversation, turn), so a conversation of any length is cut into parts of bounded size. A part's
product gives the next part its costs of entry, its backpointers give the part before its state of exit; then every
part is traced by itself. Only numbers go through Python; texts are rendered by expressions.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.lineage import written

#: States, by the role written last: nothing yet, system, user, assistant. A turn's role has the same number, 0 if unknown.
ROLES = ("", "system", "user", "assistant")
SAME_ROLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
COSTS = {"merge": 2, "insert": 4, "from_system": 5, "to_system": 8, "swap": 7, "unknown": 1}
AFTER = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # legal next roles
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _relabel(role: int, to: int) -> int:
    if role == to:
        return 0
    if role == 0:
        return COSTS["unknown"]
    return COSTS["from_system" if (role, to) == (1, 2) else "to_system" if to == 1 else "swap"]


def _inserted(state: int, before: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from ``state`` to one after which the role ``before`` is legal."""
    reached: dict[int, tuple[int, ...]] = {state: ()}
    for _ in ROLES:
        found = [path for at, path in reached.items() if before in AFTER[at]]
        if found:
            return min(found, key=lambda p: (len(p), p))
        reached = {to: path + (to,) for at, path in reached.items() for to in AFTER[at]} | reached
    return None


def _moves() -> tuple[np.ndarray, dict[int, tuple[str, tuple[int, ...]]]]:
    """Costs [role, from, to], and by role * 16 + from * 4 + to the cheapest (action, inserted roles)."""
    costs = np.full((4, 4, 4), FAR, dtype=np.int64)
    how = {}
    for role, start, to in product(range(4), range(4), (1, 2, 3)):
        options = []
        if start == to:
            options.append((COSTS["merge"] + _relabel(role, to), "merge", ()))
        empty = _inserted(start, to)
        if empty is not None:
            options.append((COSTS["insert"] * len(empty) + _relabel(role, to), "keep" if role == to else "relabel", empty))
        if options:
            best = min(options, key=lambda o: o[0])
            costs[role, start, to], how[role * 16 + start * 4 + to] = best[0], best[1:]
    return costs, how


STEP, HOW = _moves()
START = np.array([0, FAR, FAR, FAR])
# a conversation ends with an assistant's turn; after a user's an empty one is inserted, after a system's two
END = np.array([FAR, 2 * COSTS["insert"], COSTS["insert"], 0])
AT_END: dict[int, tuple[int, ...]] = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def run_product(roles: np.ndarray) -> np.ndarray:
    """Least costs [from, to] of a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        total = np.minimum((total[:, :, None] + STEP[role]).min(axis=1), FAR)
    return total


def backpointers(roles: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """[turn, state after it] -> the cheapest state before it; of equal ones the first."""
    back = np.empty((len(roles), 4), dtype=np.int64)
    for i, role in enumerate(roles):
        ways = entry[:, None] + STEP[role]
        back[i] = ways.argmin(axis=0)
        entry = np.minimum(ways.min(axis=0), FAR)
    return back


def exit_to_entry(roles: np.ndarray, entry: np.ndarray) -> np.ndarray:
    state = np.arange(4)
    for row in backpointers(roles, entry)[::-1]:
        state = row[state]
    return state


def trace(roles: np.ndarray, entry: np.ndarray, last: int) -> list[int]:
    """Keys of ``HOW``, one a turn, of the cheapest path that leaves a run in the state ``last``."""
    moves = []
    for role, row in zip(roles[::-1], backpointers(roles, entry)[::-1]):
        before = int(row[last])
        moves.append(int(role) * 16 + before * 4 + int(last))
        last = before
    return moves[::-1]


def _role_number(role: Column) -> Column:
    name = F.lower(F.trim(role))
    known = {**{r: i for i, r in enumerate(ROLES) if i}, **{a: ROLES.index(r) for a, r in SAME_ROLE.items()}}
    number = F.lit(0)
    for word, n in known.items():
        number = F.when(name == word, n).otherwise(number)
    return number


def _along(conversation: pd.DataFrame) -> pd.DataFrame:
    """Costs of entry, number of turns before, and the conversation's last state, for the parts of one conversation."""
    parts = conversation.sort_values("part")
    entry, found = START, []
    for costs in parts["product"]:
        found.append(entry)
        entry = np.minimum((entry[:, None] + np.asarray(costs).reshape(4, 4)).min(axis=0), FAR)
    return parts[["conv", "part"]].assign(entry=found, before=parts["n"].cumsum() - parts["n"], last=int((entry + END).argmin()))


def _back(conversation: pd.DataFrame) -> pd.DataFrame:
    """States of exit of a conversation's parts, from that of the last."""
    parts = conversation.sort_values("part", ascending=False)
    state, found = int(parts["last"].iloc[0]), []
    for way in parts["way"]:
        found.append(state)
        state = int(way[state])
    return parts[["conv", "part", "entry", "before"]].assign(last=found, ends=parts["part"] == parts["part"].max())


def _products(batches):
    for batch in batches:
        yield batch[["conv", "part", "n"]].assign(product=[run_product(np.asarray(r)).ravel() for r in batch["roles"]])


def _ways(batches):
    for batch in batches:
        ways = [exit_to_entry(np.asarray(r), np.asarray(e)) for r, e in zip(batch["roles"], batch["entry"])]
        yield batch[["conv", "part", "entry", "before", "last"]].assign(way=ways)


def _traced(batches):
    for batch in batches:
        moves, after = [], []
        for roles, entry, last, ends in zip(batch["roles"], batch["entry"], batch["last"], batch["ends"]):
            roles = np.asarray(roles)
            if entry is None:  # the only part of a conversation
                costs = np.minimum((START[:, None] + run_product(roles)).min(axis=0), FAR)
                entry, last, ends = START, (costs + END).argmin(), True
            moves.append(trace(roles, np.asarray(entry), int(last)))
            after.append(AT_END[int(last)] if ends else None)
        before = batch["before"].fillna(0).astype("int64")
        yield batch[["conv", "part"]].assign(moves=moves, before=before, after=after)


def _moves_of(parts: DataFrame) -> DataFrame:
    """(conv, part, moves, before, after) of (conv, part, roles, n); ``after`` is null but at a conversation's end."""
    key = "conv string, part int, "
    several = parts.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1")
    # a range splits one conversation at each of its ends, so these are at most two parts a range
    split = written(parts.join(several, "conv", "left_semi"))
    entries = (
        split.select("conv", "part", "n", "roles")
        .mapInPandas(_products, key + "n long, product array<long>")
        .groupBy("conv")
        .applyInPandas(_along, key + "entry array<long>, before long, last int")
    )
    exits = (
        split.join(entries, ["conv", "part"])
        .select("conv", "part", "roles", "entry", "before", "last")
        .mapInPandas(_ways, key + "entry array<long>, before long, last int, way array<int>")
        .groupBy("conv")
        .applyInPandas(_back, key + "entry array<long>, before long, last int, ends boolean")
    )
    known = parts.join(exits, ["conv", "part"], "left").select("conv", "part", "roles", "entry", "before", "last", "ends")
    return known.mapInPandas(_traced, key + "moves array<int>, before long, after array<int>")


def _opened(roles: Column) -> Column:
    return F.array_join(F.transform(roles, lambda r: F.concat(F.lit(OPEN), r, F.lit("\n"), F.lit(CLOSE))), "")


def _named(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.element_at(F.array(*map(F.lit, ROLES)), n + 1))


def repair_turns(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rows_per_part: int = 20_000,
) -> DataFrame:
    """``turns`` with ``repaired_role``, ``action`` (keep, relabel, merge), ``inserted`` (roles of empty turns before it),
    ``inserted_after`` (the same after a conversation's last turn), ``place`` (from 0 within the conversation) and ``rendered``.

    One row a turn; the ``rendered`` of a conversation's turns, joined in the order of ``place``, are the formatted
    conversation. Turns are ordered by ``turn`` (null first), those of one number by role (system, user, assistant, others) and then
    by a hash of role and text; repeated rows are turns of their own. Rows whose conversation is null are one conversation. An unknown or null role may become any
    role. A null text is empty. Columns of these names are replaced, others stay. Markers within a text are broken by a
    backslash, so that they do not act as markers. A conversation of one system turn gets an empty user and assistant turn.
    """
    new = ("repaired_role", "action", "inserted", "inserted_after", "place", "rendered")
    rest = [c for c in turns.columns if c not in new]
    rows = turns.select(
        F.struct(*rest).alias("row"),
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("n")).alias("conv"),
        F.col(turn).alias("turn"),
        _role_number(F.col(role)).alias("role"),
        F.xxhash64(role, text).alias("tie"),
    )
    order = ["turn", "role", "tie"]
    ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // rows_per_part))
    ranged = written(rows.repartitionByRange(ranges, "conv", *order).withColumn("part", F.spark_partition_id()))

    parts = ranged.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("sorted"))
    moves = _moves_of(written(parts.select("conv", "part", F.col("sorted.role").alias("roles"), F.size("sorted").cast("long").alias("n"))))
    each = moves.select(
        "conv", "part", "before", F.size("moves").alias("turns"), "after", F.posexplode("moves").alias("at", "move")
    )
    numbered = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1)
    done = numbered.join(each, ["conv", "part", "at"])

    number = F.col("move") % 4
    action = F.element_at(F.create_map(*[F.lit(v) for k, (a, _) in HOW.items() for v in (k, a)]), F.col("move"))
    empty = {k: i for k, (_, i) in HOW.items() if i}
    inserted = F.array().cast("array<int>")
    for k, i in empty.items():
        inserted = F.when(F.col("move") == k, F.array(*map(F.lit, i))).otherwise(inserted)
    after = F.when(F.col("at") == F.col("turns") - 1, F.col("after"))
    done = done.select(
        "row",
        _named(F.array(number))[0].alias("repaired_role"),
        action.alias("action"),
        _named(inserted).alias("inserted"),
        _named(after).alias("inserted_after"),
        (F.col("before") + F.col("at")).alias("place"),
    )
    body = F.replace(F.coalesce(F.col("row")[text], F.lit("")), F.lit("<|"), F.lit("<\\|"))
    opening = F.when(F.col("action") == "merge", F.lit("\n")).otherwise(
        F.concat(F.when(F.col("place") > 0, F.lit(CLOSE)).otherwise(""), _opened(F.col("inserted")), F.lit(OPEN), "repaired_role", F.lit("\n"))
    )
    ending = F.when(F.col("inserted_after").isNull(), "").otherwise(F.concat(F.lit(CLOSE), _opened(F.col("inserted_after"))))
    return done.select("row.*", *new[:-1], F.concat(opening, body, ending).alias("rendered"))
