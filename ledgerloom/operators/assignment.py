"""Optimal one-to-one line assignment inside each job (JN1).

Lines of a job, order and document side, come together by one hash partitioning on job_id; a partition's jobs are
solved one after the other from sorted Arrow batches, so memory is a batch and a job. Scores are memoised by
distinct texts. Ties prefer document order through a convex perturbation far below the smallest score gap;
confidences are read from the unperturbed scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import pair_score, with_price

ACCEPT = 0.50
TIE = 1e-9
ALIAS_LAYER = 6
SIDES = ("BL", "FACTURE")


def hungarian(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Row and column pairs of a minimum-cost assignment of the smaller side, and potentials u and v that prove it: u[i] + v[j] <= cost[i, j] for all, with equality for the
    pairs; on the larger side potentials are 0 or less, and 0 where a row or column is left over. So no assignment costs less than the sum of all potentials, which is this one's."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if not cost.size:
        return [], np.zeros(n), np.zeros(m)
    if n > m:
        pairs, v, u = hungarian(cost.T)
        return sorted((i, j) for j, i in pairs), u, v
    best = cost.argmin(1)
    if len(set(best.tolist())) == n:
        return [(i, int(j)) for i, j in enumerate(best)], cost.min(1), np.zeros(m)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            slack = cost[row - 1] - u[row] - v[1:]
            open_ = ~used[1:]
            better = open_ & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            step_at = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            step = least[step_at]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = step_at
        while at:
            match[at], at = match[way[at]], way[at]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]), u[1:], v[1:]


def solve(orders: list[tuple], documents: list[tuple], proof: dict | None = None) -> list[tuple[int, int, float, int]]:
    """(order index, document index, confidence, layer) of pairs accepted. Lines: (idx, ref, desc, price, alias target). proof, if given, takes the potentials
    of the order lines (u) and of the document lines (v), and all pairs of the assignment, accepted or not."""
    proof = {} if proof is None else proof
    proof.update(u=[0.0] * len(orders), v=[0.0] * len(documents), pairs=[])
    if not orders or not documents:
        return []
    settled = _all_exact(orders, documents)
    if settled is not None:
        proof["pairs"] = settled
        return settled
    score = np.zeros((len(orders), len(documents)))
    layer = np.zeros(score.shape, int)
    for i, (_, ref, desc, price, _) in enumerate(orders):
        for j, (_, ref_d, desc_d, price_d, target) in enumerate(documents):
            if target and target == ref:
                score[i, j], layer[i, j] = 1.0, ALIAS_LAYER
            else:
                base, layer[i, j] = pair_score(ref, desc, ref_d, desc_d)
                score[i, j] = with_price(base, price, price_d)
    gap = np.subtract.outer(np.arange(len(orders)), np.arange(len(documents)))
    tie = TIE * gap * gap / max(1.0, float((gap * gap).max()) / 1e4)
    pairs, u, v = hungarian(1 - score + tie)
    every = [(orders[i][0], documents[j][0], float(score[i, j]), int(layer[i, j])) for i, j in pairs]
    proof.update(u=u.tolist(), v=v.tolist(), pairs=every)
    return [p for p in every if p[2] >= ACCEPT]


def _all_exact(orders: list[tuple], documents: list[tuple]) -> list[tuple[int, int, float, int]] | None:
    """The assignment where every line of the smaller side has a full score with one line of the other and with no second one: no other
    assignment reaches that total. None where that is not so."""
    of: dict[str, list[tuple[int, int]]] = {}
    for j, (_, ref, _, _, target) in enumerate(documents):
        for key, layer in {(ref, 1), (target, ALIAS_LAYER)}:
            if key:
                of.setdefault(key, []).append((j, layer))
    found, taken = [], set()
    for order in orders:
        hits = of.get(order[1], [])
        if len({j for j, _ in hits}) > 1:
            return None
        if hits:
            j, layer = max(hits, key=lambda x: x[1])
            if j in taken:
                return None
            taken.add(j)
            found.append((order[0], documents[j][0], 1.0, layer))
    return found if len(found) == min(len(orders), len(documents)) else None


def _jobs(batches):
    """Consecutive rows of one job: (job, rows)."""
    job, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[0] != job and rows:
                yield job, rows
                rows = []
            job = row[0]
            rows.append(row[1:])
    if rows:
        yield job, rows


def _assign(batches):
    out: list[tuple] = []
    for job, rows in _jobs(batches):
        orders = [r[1:] for r in rows if r[0] == "BC"]
        for side in SIDES:
            for found in solve(orders, [r[1:] for r in rows if r[0] == side]):
                out.append((job, side, *found))
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["job_id", "side", "bc_idx", "doc_idx", "confidence", "layer"])


def _rows(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("job_id").cast("long").alias("job_id"), "side", F.col("idx").cast("int").alias("idx"), F.coalesce("ref", F.lit("")).alias("ref"),
        F.coalesce("description", F.lit("")).alias("description"), F.col("price").cast("double").alias("price"), "alias_target",
    ).repartition("job_id").sortWithinPartitions("job_id", "side", "idx")


def assign_lines(lines: DataFrame) -> DataFrame:
    """job_id, side, bc_idx, doc_idx, confidence, layer for lines (job_id, side, idx, ref, description, price, alias_target).

    side is BC, BL or FACTURE; ref and description are normalised; idx orders the lines of a job and side."""
    return _rows(lines).mapInArrow(_assign, "job_id long, side string, bc_idx int, doc_idx int, confidence double, layer int")


def _prove(batches):
    names = ["job_id", "side", "of", "idx", "potential", "mate", "confidence"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
    out: list[tuple] = []

    def written():
        cols = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for job, rows in _jobs(batches):
        orders = [r[1:] for r in rows if r[0] == "BC"]
        for side in SIDES:
            documents, proof = [r[1:] for r in rows if r[0] == side], {}
            if not documents:
                continue
            solve(orders, documents, proof)
            mates = {i: (j, c) for i, j, c, _ in proof["pairs"]}
            out += [(job, side, "BC", x[0], p, *mates.get(x[0], (None, None))) for x, p in zip(orders, proof["u"])]
            out += [(job, side, side, x[0], p, None, None) for x, p in zip(documents, proof["v"])]
        if len(out) >= 20_000:
            yield written()
    yield written()


def assignment_proof(lines: DataFrame) -> DataFrame:
    """job_id, side, of (BC or the side), idx, potential, mate, confidence: the assignment of each document side, before unlike pairs are dropped, with the potentials that prove
    it. Lines as for assign_lines; sides without lines have no rows. See optimality()."""
    return _rows(lines).mapInArrow(_prove, "job_id long, side string, of string, idx int, potential double, mate int, confidence double")


def optimality(proof: DataFrame, scores: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Checks assignments by duality, without a solver: job_id, side, total (of the accepted scores), optimal. proof as of assignment_proof; scores: job_id, side, bc_idx, doc_idx, score
    of every pair of lines, from any source. An assignment is optimal if its scores are the pairs' own, no pair costs less than its potentials, potentials of the larger side are not positive, every line of the smaller side has a
    mate, and the pairs cost what all potentials sum to. Ties are broken by amounts far below the tolerance, and that is far below the smallest gap of scores."""
    keys = ["job_id", "side"]
    bc, doc = F.col("of") == "BC", F.col("of") != "BC"
    per = proof.groupBy(*keys).agg(
        F.count_if(bc).alias("n"), F.count_if(doc).alias("m"), F.sum("potential").alias("bound"), F.max(F.when(bc, F.col("potential"))).alias("u_max"), F.max(F.when(doc, F.col("potential"))).alias("v_max"),
        F.count("mate").alias("pairs"), F.countDistinct("mate").alias("mates"), F.coalesce(F.sum(1 - F.col("confidence")), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(F.col("confidence") >= ACCEPT, F.col("confidence"))), F.lit(0.0)).alias("total"),
    )
    rows = proof.where(bc).select(*keys, F.col("idx").alias("bc_idx"), F.col("potential").alias("u"), "mate", "confidence")
    cols = proof.where(doc).select(*keys, F.col("idx").alias("doc_idx"), F.col("potential").alias("v"))
    at = scores.join(rows, [*keys, "bc_idx"]).join(cols, [*keys, "doc_idx"])
    worst = at.groupBy(*keys).agg(
        F.max(F.col("u") + F.col("v") - (1 - F.col("score"))).alias("excess"), F.max(F.when(F.col("mate") == F.col("doc_idx"), F.abs(F.col("score") - F.col("confidence")))).alias("off"), F.count(F.lit(1)).alias("all"),
    )
    free = F.when(F.col("n") > F.col("m"), F.col("u_max")).when(F.col("n") < F.col("m"), F.col("v_max")).otherwise(F.lit(0.0))
    small = F.least("n", "m")
    optimal = (free <= tolerance) & (F.col("excess") <= tolerance) & (F.col("off") <= 1e-9) & (F.col("all") == F.col("n") * F.col("m")) & (F.col("pairs") == small) & (F.col("mates") == small)
    return per.join(worst, keys).select(*keys, "total", (optimal & (F.abs(F.col("cost") - F.col("bound")) <= tolerance * F.greatest(F.lit(1), small))).alias("optimal"))
