"""Edit alignment of token arrays: forced match on equal tokens, ties in the order D, I, S.

``paths`` fills the cost tables of many pairs at once, one anti-diagonal after the other, and
keeps one byte a cell for the backtrace; ``with_path`` runs it over Arrow batches.  ``align`` is
the same as a column expression for short pairs: a fold over the hypothesis that carries one
row of the table, whose cells carry counts and path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of cost tables that a task holds at a time, about; a pair with more is aligned by ``long_path``.
CELLS = 30_000_000

CELL = "struct<c:int,m:int,d:int,i:int,s:int,path:string>"


def _cell(c, m, d, i, s, path):
    names = ("c", "m", "d", "i", "s", "path")
    return F.struct(*[x.cast("string" if n == "path" else "int").alias(n) for n, x in zip(names, (c, m, d, i, s, path), strict=True)])


def _step(cell: Column, op: str, cost: int) -> Column:
    add = {n: F.lit(int(n == op.lower())) for n in "mdis"}
    return _cell(cell["c"] + cost, cell["m"] + add["m"], cell["d"] + add["d"], cell["i"] + add["i"], cell["s"] + add["s"], F.concat(cell["path"], F.lit(op)))


def align(ref: Column, hyp: Column, deletion: int = 1, insertion: int = 1, substitution: int = 1) -> Column:
    """The last cell of the cost table: struct c (distance), m, d, i, s and path."""
    zero = F.lit(0)
    first = F.transform(F.sequence(zero, F.size(ref)), lambda q: _cell(q * deletion, zero, q, zero, zero, F.repeat(F.lit("D"), q)))

    def cell(done: Column, above: Column, q: Column, token: Column) -> Column:
        left, up, across = F.element_at(done, -1), F.element_at(above, q + 1), F.element_at(above, q)
        best = F.when((left["c"] + deletion <= up["c"] + insertion) & (left["c"] + deletion <= across["c"] + substitution), _step(left, "D", deletion))
        best = best.when(up["c"] + insertion <= across["c"] + substitution, _step(up, "I", insertion)).otherwise(_step(across, "S", substitution))
        return F.when(F.element_at(ref, q) == token, _step(across, "M", 0)).otherwise(best)

    def row(above: Column, token: Column) -> Column:
        start = F.array(_step(F.element_at(above, 1), "I", insertion))
        places = F.when(F.size(ref) > 0, F.sequence(F.lit(1), F.size(ref))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, lambda done, q: F.concat(done, F.array(cell(done, above, q, token))))

    return F.element_at(F.aggregate(hyp, first, row), -1)


def align_tokens(ref: list[str], hyp: list[str]) -> str:
    """The path of one pair; plain Python, for long texts and tests."""
    cost = [[0] * (len(ref) + 1) for _ in range(len(hyp) + 1)]
    op = [["I"] * (len(ref) + 1) for _ in range(len(hyp) + 1)]
    cost[0], op[0] = list(range(len(ref) + 1)), ["D"] * (len(ref) + 1)
    for p, h in enumerate(hyp, 1):
        cost[p][0] = p
        for q, r in enumerate(ref, 1):
            if r == h:
                cost[p][q], op[p][q] = cost[p - 1][q - 1], "M"
            else:
                cost[p][q], _, op[p][q] = min((cost[p][q - 1] + 1, 0, "D"), (cost[p - 1][q] + 1, 1, "I"), (cost[p - 1][q - 1] + 1, 2, "S"))
    p, q, path = len(hyp), len(ref), []
    while p or q:
        o = op[p][q] if p and q else "I" if p else "D"
        path.append(o)
        p, q = p - (o != "D"), q - (o != "I")
    return "".join(reversed(path))


def table_paths(refs: list[list], hyps: list[list], cost: tuple[int, int, int]) -> list[str]:
    deletion, insertion, substitution = cost
    known: dict = {}
    number = lambda tokens: [known.setdefault(t, len(known)) for t in tokens]
    n, m = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    k, wide, high = len(refs), int(n.max()), int(m.max())
    ref, hyp = np.full((k, wide + 1), -1, np.int32), np.full((k, high + 1), -2, np.int32)
    for i in range(k):
        ref[i, 1 : n[i] + 1], hyp[i, 1 : m[i] + 1] = number(refs[i]), number(hyps[i])
    back = np.zeros((k, high + 1, wide + 1), np.uint8)  # 0 D, 1 I, 2 S, 3 M
    back[:, 1:, 0] = 1
    before, last = None, np.zeros((k, high + 1), np.int32)
    for d in range(1, high + wide + 1):
        now = np.zeros((k, high + 1), np.int32)
        if d <= wide:
            now[:, 0] = d * deletion
        if d <= high:
            now[:, d] = d * insertion
        p = np.arange(max(1, d - wide), min(high, d - 1) + 1)
        if len(p):
            q = d - p
            left, up, across = last[:, p] + deletion, last[:, p - 1] + insertion, before[:, p - 1]
            same = hyp[:, p] == ref[:, q]
            op = np.where((left <= up) & (left <= across + substitution), 0, np.where(up <= across + substitution, 1, 2))
            now[:, p] = np.where(same, across, np.minimum(np.minimum(left, up), across + substitution))
            back[:, p, q] = np.where(same, 3, op)
        before, last = last, now
    out = np.zeros((k, high + wide), np.uint8)
    p, q, rows, at = m.copy(), n.copy(), np.arange(k), 0
    while True:
        on = (p > 0) | (q > 0)
        if not on.any():
            break
        op = back[rows, p, q]
        out[:, at] = np.where(on, op + 1, 0)
        p -= on & (op != 0)
        q -= on & (op != 1)
        at += 1
    letters = np.frombuffer(b" DISM", np.uint8)
    return [letters[row[row > 0][::-1]].tobytes().decode() for row in out]


#: Ranges of anti-diagonals that a longer one is cut into.
PARTS = 32


def long_path(ref: list, hyp: list, cost: tuple[int, int, int], cells: int | None = None) -> str:
    """The path of one pair in little space: the same as that of the whole table.

    Costs go forward one anti-diagonal after the other, and only the two at the begin of each of PARTS ranges stay.  Then ranges
    are taken from the last to the first; one that has more than ``cells`` cells is cut again, others get a table of steps that
    is walked back.  Space is cells bytes and PARTS anti-diagonals a level; time grows by a factor for each level.
    """
    cells = CELLS if cells is None else cells
    deletion, insertion, substitution = cost
    known: dict = {}
    number = lambda tokens: np.array([0, *(known.setdefault(t, len(known) + 1) for t in tokens)], np.int32)
    r, h = number(ref), number(hyp)
    n, m = len(r) - 1, len(h) - 1

    def advance(before, last, d, back=None):
        now = np.zeros(m + 1, np.int32)
        lo, hi = max(1, d - n), min(m, d - 1)
        if lo <= hi:
            left, up, across = last[lo : hi + 1] + deletion, last[lo - 1 : hi] + insertion, before[lo - 1 : hi]
            same = h[lo : hi + 1] == r[d - hi : d - lo + 1][::-1]
            swap = across + substitution
            best = np.minimum(np.minimum(left, up), swap)
            now[lo : hi + 1] = np.where(same, across, best)
            if back is not None:
                back[lo : hi + 1] = np.where(same, 3, np.where(left == best, 0, np.where(up == best, 1, 2)))
        if d <= n:
            now[0] = d * deletion
        if d <= m:
            now[d] = d * insertion
        return last, now

    out = bytearray()

    def walk(lo, hi, before, last, p, q):
        """Steps back from the cell (p, q), on the anti-diagonal hi at most, to lo or before; before and last are those of lo - 1 and lo."""
        if hi - lo <= 2 or (hi - lo) * (m + 1) <= cells:
            back = np.zeros((hi - lo, m + 1), np.uint8)
            for d in range(lo + 1, hi + 1):
                before, last = advance(before, last, d, back[d - lo - 1])
            while p + q > lo:
                step = 1 if not q else 0 if not p else back[p + q - lo - 1, p]
                out.append(b"DISM"[step])
                p, q = p - (step != 0), q - (step != 1)
            return p, q
        size = -(-(hi - lo) // PARTS)
        starts = list(range(lo, hi, size))
        kept = []
        for a in starts:
            kept.append((before, last))
            if a != starts[-1]:
                for d in range(a + 1, a + size + 1):
                    before, last = advance(before, last, d)
        for a, pair in zip(reversed(starts), reversed(kept), strict=True):
            if p + q > a:
                p, q = walk(a, min(hi, a + size), *pair, p, q)
            kept.pop()
        return p, q

    walk(0, n + m, np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32), m, n)
    return bytes(reversed(out)).decode()


def paths(refs: list[list], hyps: list[list], cost: tuple[int, int, int] = (1, 1, 1)) -> list[str]:
    """The paths of many pairs; cost: deletion, insertion, substitution."""
    order = sorted(range(len(refs)), key=lambda i: (len(refs[i]), len(hyps[i])))
    out, part = [""] * len(refs), []

    def work() -> None:
        if len(part) == 1 and (len(refs[part[0]]) + 1) * (len(hyps[part[0]]) + 1) > CELLS:
            out[part[0]] = long_path(refs[part[0]], hyps[part[0]], cost)
            return
        for i, path in zip(part, table_paths([refs[i] for i in part], [hyps[i] for i in part], cost), strict=True):
            out[i] = path

    high = 0
    for i in order:
        high = max(high, len(hyps[i]))
        if part and (len(part) + 1) * (high + 1) * (len(refs[i]) + 1) > CELLS:
            work()
            part, high = [], len(hyps[i])
        part.append(i)
    if part:
        work()
    return out


def with_path(pairs: DataFrame, ref: str, hyp: str, cost: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """pairs with a column path; null token arrays count as empty."""

    def run(batches):
        for batch in batches:
            found = paths([r or [] for r in batch.column(ref).to_pylist()], [h or [] for h in batch.column(hyp).to_pylist()], cost)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "path"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("path", T.StringType())]))


def aligned_pairs(ref: Column, hyp: Column, path: Column) -> Column:
    """(pos, op, ref, hyp) for each step of a path, of string tokens; empty where there is no path.  Each path is walked once."""

    def walk(ref: pa.Array, hyp: pa.Array, path: pa.Array) -> pa.Array:
        steps = [(p or "").encode() for p in path.to_pylist()]
        size = np.array([len(p) for p in steps], np.int64)
        op = np.frombuffer(b"".join(steps), np.uint8)
        row = np.repeat(np.arange(len(steps)), size)
        begin = np.cumsum(size) - size

        def tokens(side: pa.Array, takes: np.ndarray) -> pa.Array:
            upto = np.cumsum(takes)
            before = np.concatenate(([0], upto))[begin]  # taken by earlier paths
            first = np.array(side.offsets, np.int64)[:-1]
            return side.values.take(pa.array(first[row] + upto - 1 - before[row], mask=~takes)).cast(pa.string())

        parts = [pa.array((np.arange(len(op)) - begin[row] + 1).astype(np.int32)), pa.array([chr(o) for o in op], pa.string()), tokens(ref, op != ord("I")), tokens(hyp, op != ord("D"))]
        return pa.ListArray.from_arrays(pa.array(np.append(begin, len(op)).astype(np.int32)), pa.StructArray.from_arrays(parts, names=["pos", "op", "ref", "hyp"]))

    return F.arrow_udf(walk, "array<struct<pos:int,op:string,ref:string,hyp:string>>")(ref, hyp, path)
