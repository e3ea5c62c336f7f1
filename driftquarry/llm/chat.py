"""Chat formatting: minimum-cost repair of roles, then rendering.

A conversation is legal if it is an optional system turn, then user and assistant in turn, user first and
assistant last. Repair finds the cheapest way there by dynamic programming over turns and the automaton's
states. For each turn it may

- relabel: give the turn another role (RELABEL; a role unknown to the automaton has to be relabelled),
- merge: join the turn to the one before, of the same role after relabelling (MERGE),
- insert: put an empty turn of the other role before it (INSERT), or an empty assistant turn at the end.

Of equally cheap repairs, the one whose choices come first in the order above at the earliest turn is taken, and
roles in the order system, user, assistant; so the result is determined. The repair depends on the sequence of
roles only and is remembered by it.

Defined cases. A null role is unknown; a null text is an empty text. Roles are compared without white space around
them and in lower case. A text's own `<|` is rendered as `< |`, so that no text can pass for a turn. Turns are in order of `turn` (null first), then role, then text; repeated rows are further turns. Rows with
a null conversation id are left out. A conversation's turns must fit in one task's memory, however many they are.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

ROLES = ("system", "user", "assistant")
RELABEL, MERGE, INSERT = 2, 1, 3
#: What a turn is rendered as.
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
#: What opens the template's marks, and what stands for it within texts.
MARK, PLAIN = "<|", "< |"
#: State: the last role, or nothing yet. Roles that may follow it without an insertion, or with one of the role named.
_START = "start"
_NEXT = {_START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
_VIA = {_START: {"assistant": "user"}, "system": {"assistant": "user"}, "user": {"user": "assistant"}, "assistant": {"assistant": "user"}}

Step = tuple[str, str, str | None]


def repair(roles: tuple[str, ...]) -> tuple[int, list[Step]]:
    """(cost, steps): per turn its role and whether it is "new" or "merge", and the role of an empty turn inserted before it; a last step "end" may insert one at the end."""
    n = len(roles)
    # From the last turn to the first: cost[state] of the rest, so that the earliest choice decides ties.
    ahead: dict[str, tuple[int, Step | None, str | None]] = {s: (0, None, None) for s in ("assistant",)}
    ahead |= {"user": (INSERT, ("assistant", "end", "assistant"), None), "system": (2 * INSERT, ("assistant", "end", "user"), None), _START: (0, None, None)}
    table = [ahead]
    for i in range(n - 1, -1, -1):
        here: dict[str, tuple[int, Step | None, str | None]] = {}
        for state in (_START, *ROLES):
            best = None
            options: list[tuple[int, Step]] = []
            for role in ROLES:
                label = 0 if roles[i] == role else RELABEL
                if role in _NEXT[state]:
                    options.append((label, (role, "new", None)))
                if role == state:
                    options.append((label + MERGE, (role, "merge", None)))
                if role in _VIA[state]:
                    options.append((label + INSERT, (role, "new", _VIA[state][role])))
            for own, step in options:
                cost = own + table[-1][step[0]][0]
                key = (cost, step[0] != roles[i], step[1] == "merge", step[2] is not None)
                if best is None or key < best[0]:
                    best = (key, cost, step)
            here[state] = (best[1], best[2], best[2][0])
        table.append(here)
    table.reverse()
    state, steps = _START, []
    for i in range(n):
        _, step, state = table[i][state]
        steps.append(step)
    if n and table[n][state][1]:
        steps.append(table[n][state][1])
    return (table[0][_START][0] if n else 0), steps


def render(steps: list[Step], texts: list[str], template: str = TEMPLATE) -> tuple[str, list[str]]:
    """The rendered conversation and its roles."""
    turns: list[list] = []
    for k, (role, how, inserted) in enumerate(steps):
        if how == "end":
            turns += [["user", ""]] * (inserted == "user") + [["assistant", ""]]
            continue
        if inserted:
            turns.append([inserted, ""])
        if how == "merge":
            turns[-1][1] += ("\n" if turns[-1][1] and texts[k] else "") + texts[k]
        else:
            turns.append([role, texts[k]])
    return "".join(template.format(role=r, text=t.replace(MARK, PLAIN)) for r, t in turns), [r for r, _ in turns]


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, cost, roles, rendered): each conversation repaired at minimum cost."""
    bound_batches(turns.sparkSession)
    ordered = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", "")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    flat = ordered.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], tuple[int, list[Step]]] = {}
        for batch in batches:
            costs, roles, texts = [], [], []
            for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                key = tuple(x or "" for x in r)
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = repair(key)
                cost, steps = known[key]
                rendered, now = render(steps, t, template)
                costs.append(cost)
                roles.append(",".join(now))
                texts.append(rendered)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "cost", "roles", "rendered"])

    kind = dict(turns.dtypes)["conv_id"]
    return flat.mapInArrow(run, f"conv_id {kind}, cost int, roles string, rendered string")
