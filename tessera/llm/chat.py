"""Chat formatting over reply trees.

Replies point to their parents. Iterative self-joins double the reach of each message's pointer (to the
parent, the grandparent, four up, ...) together with the score gathered on the way, until every pointer is
past its root; so a thread of n messages takes log2(n) joins. The leaves of each tree are ranked by the
score of their path, the best ones chosen, and joins with the same pointers, the longest first, enumerate
each chosen path. Each path becomes one text.

The template is <|role|>text<|end|> for each turn. Inside roles and texts a backslash, <, [ and | are
written \\\\, \\x3c, \\x5b and \\x7c, so no control string of this or of another template can stand there, and parse() gives
back every turn. The loss mask is the spans of what assistants say.

Rows: null roles and texts are empty. A parent that isn't in the table makes a root; messages on a cycle,
and those below one, have no root and give no path. Equal scores are ranked by the leaf's id. Repeated ids are
taken once (the least parent and score, the least role and text), but where a table of turns has no ids each
row is a turn. Rows without an id are left out. Empty tables give empty results. A conversation is one row in
the end, so it must fit a task, as must any long text; its tree is only sorted there, and may spill. Extra
columns don't matter: the needed ones are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

ESCAPES = {"\\": "\\\\", "<": "\\x3c", "[": "\\x5b", "|": "\\x7c"}
#: Doublings after which what still has no root is on a cycle: threads reach 2 ** LEVELS messages.
LEVELS = 32


def escape(text: str) -> str:
    return text.translate(str.maketrans(ESCAPES))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|x3c|x5b|x7c)", lambda m: {"\\": "\\", "x3c": "<", "x5b": "[", "x7c": "|"}[m[1]], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of what role `learn` says."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<|{escape(role)}|>", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|end|>"]
        at += len(head) + len(body) + len("<|end|>")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.index("<|end|>", at)
        head, _, body = formatted[at + 2 : end].partition("|>")
        turns.append((unescape(head), unescape(body)))
        at = end + len("<|end|>")
    return turns


def best_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str, branches: int = 1) -> DataFrame:
    """One row for each message on a chosen path: tree, leaf, path_rank, path_score, up (steps from the leaf), node.

    node is unique within tree (of repeated ids the least parent and score count); parent is null at roots; score is
    a number for each message.
    """
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("x")).select("tree", "node", "x.parent", "x.score")
    rows = materialize(rows, "tree")
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = rows.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up"), "score")
    state, levels = materialize(up, "up0"), []
    while len(levels) < LEVELS and not (active := state.where("up is not null")).isEmpty():
        levels.append((active, state))
        a, b = active.alias("a"), state.alias("b")  # pointers past a root stay as they are
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))
        further = a.join(b, on).select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.score") + F.col("b.score")).alias("score"))
        state = materialize(state.where("up is null").unionByName(further), f"up{len(levels)}")
        if len(levels) > 1 and state.where("up is null").count() == levels[-1][1].where("up is null").count():
            break  # no pointer has got past a root: what is left is on cycles or below one
    inner = rows.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = state.where("up is null").join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "node"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), rank.alias("path_rank"), F.col("score").alias("path_score")).where(F.col("path_rank") <= branches)
    found = materialize(chosen.select("*", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("node")), "path")
    discard(rows, state)
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k][0].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("above"))
        more = found.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        before, found = found, materialize(found.unionByName(more.select("tree", "leaf", "path_rank", "path_score", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("node"))), f"path{k}")
        discard(before, levels[k][1])
    return found


def _turns(order: list) -> Column:
    return (F.row_number().over(W.partitionBy("tree", "is_path").orderBy(*order)) - 1).cast("long")


def format_paths(paths: DataFrame, messages: DataFrame, tree: str, node: str | None, role: str, text: str, learn: str = "assistant", turn: str | None = None) -> DataFrame:
    """One row per path: tree, leaf, path_rank, path_score, formatted, loss_spans (array of start and end).

    node names the messages' ids (of repeated ids the least role and text count); where it is None, messages are
    known by their places in the order of turn, as linear() numbers them. Texts are shuffled once, by tree: paths
    and messages stand in one table, a path's row takes the text of the message before it, and all rows of a path
    are then where they are needed.
    """
    named = F.lit(None).cast("long") if node is None else F.col(node)
    none = F.lit(None).cast("string")
    said = messages.select(F.col(tree).alias("tree"), named.alias("node"), (F.lit(None).cast("long") if turn is None else F.col(turn)).alias("o"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("is_path"))
    kinds = dict(paths.dtypes)
    for c in ("leaf", "path_rank", "path_score", "up"):
        said = said.withColumn(c, F.lit(None).cast(kinds[c]))
    given = paths.select("tree", "node", F.lit(None).cast(dict(said.dtypes)["o"]).alias("o"), none.alias("role"), none.alias("text"), F.lit(True).alias("is_path"), "leaf", "path_rank", "path_score", "up")
    both = said.unionByName(given).repartition("tree")
    if node is None:
        both = both.withColumn("node", F.when(F.col("is_path"), F.col("node")).otherwise(_turns(_order("o", "role", "text"))))
    at = W.partitionBy("tree", "node").orderBy("is_path", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    for c in ("role", "text"):
        both = both.withColumn(c, F.first(c, ignorenulls=True).over(at))
    turn_ = F.struct((-F.col("up")).alias("at"), "role", "text")
    turns = both.where("is_path").groupBy("tree", "leaf", "path_rank", "path_score").agg(F.sort_array(F.collect_list(turn_)).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns], learn) for turns in batch["turns"]]
            batch = batch.drop(columns="turns")
            batch["formatted"] = [m[0] for m in made]
            batch["loss_spans"] = [[{"start": a, "end": b} for a, b in m[1]] for m in made]
            yield batch

    kinds = dict(turns.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("tree", "leaf", "path_rank", "path_score")) + ", formatted string, loss_spans array<struct<start: int, end: int>>"
    return turns.mapInPandas(run, schema)


def _order(turn: str, role: str, text: str) -> list:
    """By turn; ties by role and a hash of the text, which needn't be moved for it."""
    return [F.col(turn), F.coalesce(role, F.lit("")), F.xxhash64(F.coalesce(text, F.lit("")))]


def linear(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of conversations by turn as reply trees, without texts: conv, node (place from 0), parent (the place before), score (characters).

    Every row is a message of its own, equal ones too.
    """
    rows = df.select(F.col(conv).alias("conv"), *[x.alias(f"o{i}") for i, x in enumerate(_order(turn, role, text))], F.coalesce(F.char_length(text), F.lit(0)).cast("double").alias("score"))
    rows = rows.withColumn("node", (F.row_number().over(W.partitionBy("conv").orderBy("o0", "o1", "o2")) - 1).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "score")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each formatted text, from the text and its spans."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [parse(f) for f in batch["formatted"]]
            learned = ["".join(unescape(f[s["start"] : s["end"]]) for s in spans) for f, spans in zip(batch["formatted"], batch["loss_spans"], strict=True)]
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            yield pd.DataFrame({"tree": batch["tree"], "n_turns": [len(t) for t in turns], "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns], "loss_chars": [len(x) for x in learned], "loss_sha256": [sha(x) for x in learned], "formatted_chars": [len(f) for f in batch["formatted"]]})

    kind = dict(formatted.dtypes)["tree"]
    return formatted.select("tree", "formatted", "loss_spans").mapInPandas(run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
