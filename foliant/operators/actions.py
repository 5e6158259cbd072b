"""Ordered file actions replayed against a simulated tree, so that a dry run says what a run would do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "plan string, idx bigint, op string, status string, reason string"


class Tree:
    """What exists: the given entries, plus and minus what actions have done."""

    def __init__(self, entries: dict[str, tuple[str, str | None]]):
        self.entries = dict(entries)
        for path in entries:
            for up in _above(path):
                self.entries.setdefault(up, ("dir", None))
        self.entries.setdefault("/", ("dir", None))

    def kind(self, path: str) -> str | None:
        return self.entries.get(path, (None, None))[0]

    def digest(self, path: str) -> str | None:
        return self.entries.get(path, (None, None))[1]

    def make(self, path: str) -> None:
        for p in [*_above(path)[::-1], path]:
            self.entries.setdefault(p, ("dir", None))

    def take(self, path: str) -> dict[str, tuple[str, str | None]]:
        below = path.rstrip("/") + "/"
        gone = {p: e for p, e in self.entries.items() if p == path or p.startswith(below)}
        for p in gone:
            del self.entries[p]
        return gone


def _above(path: str) -> list[str]:
    parts = path.strip("/").split("/")[:-1]
    return ["/" + "/".join(parts[:n]) for n in range(len(parts), 0, -1)] + ["/"]


def judge(tree: Tree, op: str, src: str | None, dst: str | None, sha: str | None) -> tuple[str, str]:
    """(status, reason) of one action, done to the tree if it is possible."""
    for path in (src, dst):
        if path and ".git" in path.lower().split("/"):
            return "refused", "path under .git"
    if src and dst:
        if src.lower() == dst.lower():
            return "refused", "source and destination are the same"
        if dst.lower().startswith(src.lower().rstrip("/") + "/"):
            return "refused", "destination is inside the source"
    if op == "mkdir":
        kind = tree.kind(dst)
        if kind == "dir":
            return "ok", "already there"
        if kind:
            return "refused", "destination is a file"
        if any(tree.kind(p) not in (None, "dir") for p in _above(dst)):
            return "refused", "destination parent is a file"
        tree.make(dst)
        return "ok", "would create directory"
    if op not in ("copy", "move", "recycle"):
        return "refused", "unknown op"
    kind = tree.kind(src) if src else None
    if kind is None:
        return "refused", "source is missing"
    if sha and kind == "dir":
        return "refused", "sha256 not applicable to a directory"
    if sha and tree.digest(src) and sha.lower() != tree.digest(src).lower():
        return "refused", "sha256 differs"
    if op == "recycle":
        tree.take(src)
        return "ok", "would recycle"
    if op == "copy" and kind != "file":
        return "refused", "only files are copied"
    if tree.kind(dst) is not None:
        return "refused", "destination exists"
    if tree.kind(_above(dst)[0]) != "dir":
        return "refused", "destination parent is missing"
    if op == "copy":
        tree.entries[dst] = tree.entries[src]
    else:
        for path, entry in tree.take(src).items():
            tree.entries[dst + path[len(src) :]] = entry
    return "ok", f"would {op}"


def replay(actions: DataFrame, entries: DataFrame, *, stop_on_error: bool = False) -> DataFrame:
    """plan, idx, op, status, reason for each action (plan, idx, op, src, dst, sha256), in the order of idx.

    ``entries`` (plan, path, kind, sha256) is what each plan finds.  An action sees what those before it did,
    which no window frame can say, so each plan is one group: a plan is a document that one run executes.
    """

    def run(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        tree = Tree({r.path: (r.kind, r.sha256) for r in there.itertuples()})
        out, stopped = [], False
        for a in own.sort_values("idx").itertuples():
            value = lambda x: None if x is None or x != x or x == "" else x
            status, reason = ("skipped", "stopped after an error") if stopped else judge(tree, a.op, value(a.src), value(a.dst), value(a.sha256))
            stopped = stopped or (stop_on_error and status == "refused")
            out.append((a.plan, a.idx, a.op, status, reason))
        return pd.DataFrame(out, columns=["plan", "idx", "op", "status", "reason"])

    return actions.groupBy("plan").cogroup(entries.groupBy("plan")).applyInPandas(run, RESULT)


def inverse(actions: DataFrame) -> DataFrame:
    """The undo of done actions, last first: moves go back, copies are recycled, folders removed if empty, recycled
    files are left to the user."""
    op = F.when(F.col("op") == "move", "move").when(F.col("op") == "copy", "recycle").when(F.col("op") == "mkdir", "rmdir").otherwise("manual")
    src = F.when(F.col("op").isin("move", "copy", "mkdir"), F.col("dst")).otherwise(F.col("src"))
    return actions.select("plan", (-F.col("idx")).alias("undo_order"), op.alias("op"), src.alias("src"), F.when(F.col("op") == "move", F.col("src")).alias("dst"))


def counts(results: DataFrame, statuses: tuple[str, ...] = ("ok", "refused", "skipped")) -> DataFrame:
    """One row: total and the number of each status, zeros too."""
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
