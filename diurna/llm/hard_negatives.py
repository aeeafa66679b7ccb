"""Hard negatives by exact inner-product search over lists that clusters of anchors share.

Anchors are clustered by angle. For a cluster and a block of candidates the candidates are sorted
once by an upper bound of what any member can score with them: a member u of a cluster with centre c
and half-angle b scores with candidate i at most |u| |i| cos(max(0, angle(i, c) - b)). Every member
walks that one list in chunks until its own bound is lower than all that it still looks for;
the rest of the list is certified not to matter, so results are exact.

Two searches: each anchor's ``positives`` best rows of its label, then for each positive of
score p the ``negatives`` best rows of other labels with low * p <= 100 * score <= high * p. Both are
walks for targets (label equal or not, lowest and highest score, how many).

On Spark: rows get numbers and are hashed into candidate blocks of bounded size; anchors go by
cluster into groups and packs of bounded size (a cluster of any size is several groups, a hot
vector is no hot key). Every pack meets every block in a task of its own - the query set against
all rows, in blocks - and returns at most the wanted number of rows per target; these are merged by
rank. A sample of at most ``sample`` rows, by the hash of the row number, gives the cluster centres
and the first lower bound of each target, with which all walks begin; it changes no result.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part
(``quantised``); shorter vectors count as filled up with zeros; every row is a row of its own, so
repeated rows are each other's positives and repeated anchors have each their rows; equal scores
stand by ascending id, null last; a null id is no anchor unless the condition says so; an anchor
without positives or without negatives gives no row; empty tables give an empty result. Scores are
64-bit integers: components whose products could pass that raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class HardNegatives:
    positives: int = 5
    negatives: int = 3
    low: int = 50               # percent of the positive's score
    high: int = 95
    clusters: int = 16
    sample: int = 2048          # rows that give centres and first bounds
    rounds: int = 8             # of the centres' fit
    group_rows: int = 256       # anchors that share lists, at most about
    pack_rows: int = 4096       # anchors of a pack, about
    block_rows: int = 2048      # candidates of a block, about
    chunk: int = 256            # of a walk


def quantised(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with ``vector`` as floor(scale * x) of each component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & whole).withColumn(
        "vector", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


# ---- the walk ---------------------------------------------------------------------------

@dataclass
class Vectors:
    row: np.ndarray
    id: np.ndarray              # ids, and which of them are null
    no_id: np.ndarray
    label: np.ndarray
    at: np.ndarray              # integer components, one row each

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, dim: int) -> "Vectors":
        column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
        v, ids = column("vector"), column("id")
        at = np.zeros((len(v), dim), np.int64)
        n = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(v)), n)
        at[owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
        return Vectors(column("row").to_numpy(), pc.fill_null(ids, 0).to_numpy(),
                       pc.is_null(ids).to_numpy(zero_copy_only=False), column("label").to_numpy(), at)

    def take(self, i) -> "Vectors":
        return Vectors(self.row[i], self.id[i], self.no_id[i], self.label[i], self.at[i])


@dataclass
class Targets:
    """What anchors look for: ``count`` best rows of their label or (``same`` False) of others."""
    owner: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool
    count: int


def norms(at: np.ndarray) -> np.ndarray:
    return np.sqrt((at.astype(np.float64) ** 2).sum(axis=1))


def units(at: np.ndarray) -> np.ndarray:
    return at / np.maximum(norms(at), 1e-300)[:, None]


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in doubles where these hold every sum."""
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if exact else a @ b.T


def shared_list(members: np.ndarray, candidates: np.ndarray):
    """(order, bounds): candidates by falling bound of their product with any member of length one."""
    u = units(members)
    centre = u.sum(axis=0)
    centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else np.eye(1, len(centre))[0]
    angle = lambda x: np.arccos(np.clip(units(x) @ centre, -1.0, 1.0))
    half = np.where(norms(members) > 0, angle(members), 0.0).max(initial=0.0)
    # 1e-6: rounding of the angles
    bound = norms(candidates) * np.cos(np.maximum(angle(candidates) - half - 1e-6, 0.0))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(members: Vectors, candidates: Vectors, targets: Targets, floor: np.ndarray, chunk: int, exact: bool):
    """Per target the (places, scores) of its best candidates; ``floor`` is a score below which none counts."""
    order, bound = shared_list(members.at, candidates.at)
    length = norms(members.at)
    slack = 1e-9 * length * (norms(candidates.at).max(initial=0.0) + 1) + 1e-6
    need = np.maximum(targets.lo, floor)
    none = np.zeros(0, np.int64)
    best = [(none, none)] * len(need)
    for p in range(0, len(order), chunk):
        # a target goes on while a candidate may reach what it needs; equal scores may win by id
        top = (length * bound[p] + slack)[targets.owner]
        live = np.flatnonzero((need <= targets.hi) & (top >= need))
        if not len(live):
            break
        some = order[p:p + chunk]
        owners, at = np.unique(targets.owner[live], return_inverse=True)
        got = scores(members.at[owners], candidates.at[some], exact)
        fits = (members.label[owners][:, None] == candidates.label[some]) == targets.same
        fits &= members.row[owners][:, None] != candidates.row[some]
        got_t = got[at]
        hit = fits[at] & (got_t >= need[live][:, None]) & (got_t <= targets.hi[live][:, None])
        for t in np.flatnonzero(hit.any(axis=1)):
            of = live[t]
            places = np.append(best[of][0], some[hit[t]])
            points = np.append(best[of][1], got_t[t][hit[t]])
            keep = np.lexsort((candidates.row[places], candidates.id[places], candidates.no_id[places],
                               -points))[:targets.count]
            best[of] = places[keep], points[keep]
            if len(keep) == targets.count:
                need[of] = max(need[of], points[keep[-1]])
    return best


def centres(at: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k directions, by spherical k-means from spread rows; the same for the same rows."""
    u = units(at)
    if not len(u):
        return np.zeros((1, at.shape[1]))
    chosen, near = [0], u @ u[0]
    while len(chosen) < min(k, len(u)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, u @ u[chosen[-1]])
    c = u[chosen]
    for _ in range(rounds):
        own = (u @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, u)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


# ---- on Spark ---------------------------------------------------------------------------

def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _cells(packs: DataFrame, blocks: DataFrame, n_packs: int, n_blocks: int, cfg: HardNegatives, dim: int,
           exact: bool, same: bool) -> DataFrame:
    """(anchor_row, tag, id, row, score): every pack of anchors walks every block of candidates."""
    count = cfg.positives if same else cfg.negatives

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        for pack in left.column("pack").to_pylist():
            table = _unpack(pack)
            anchors, groups = Vectors.of(table, dim), table.column("group").to_numpy()
            owner, tag, lo, hi, floor = (np.asarray(x, np.int64) for x in _targets(table))
            for block in right.column("block").to_pylist():
                candidates = Vectors.of(_unpack(block), dim)
                for g in np.unique(groups):
                    members = np.flatnonzero(groups == g)
                    mine = np.flatnonzero(groups[owner] == g)
                    targets = Targets(np.searchsorted(members, owner[mine]), lo[mine], hi[mine], same, count)
                    for t, (places, points) in zip(mine, walk(anchors.take(members), candidates, targets,
                                                              floor[mine], cfg.chunk, exact)):
                        n = len(places)
                        ids = [None if z else i for i, z in zip(candidates.id[places].tolist(), candidates.no_id[places])]
                        for x, v in zip(out, ([int(anchors.row[owner[t]])] * n, [int(tag[t])] * n, ids,
                                              candidates.row[places].tolist(), points.tolist())):
                            x.extend(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                         *(pa.array(x, pa.int64()) for x in out[2:])],
                        names=["anchor_row", "tag", "id", "row", "score"])
    a = packs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    b = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    return a.groupBy("a", "c").cogroup(b.groupBy("a", "c")).applyInArrow(
        run, "anchor_row bigint, tag int, id bigint, row bigint, score bigint")


def _targets(table: pa.Table):
    """Flat (owner, tag, lo, hi, floor) of a pack's targets."""
    lists = table.column("targets").combine_chunks()
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    return owner, *(flat.field(x).to_numpy() for x in ("tag", "lo", "hi", "floor"))


def _packs(anchors: DataFrame, sample: bytes, cfg: HardNegatives, dim: int, exact: bool, same: bool) -> DataFrame:
    """(a, pack): anchors with ``targets`` array<struct<tag, lo, hi>>, and each target's first bound."""
    shared = anchors.sparkSession.sparkContext.broadcast(sample)
    count = cfg.positives if same else cfg.negatives
    names = ["row", "id", "label", "vector", "group"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        mine, known = Vectors.of(rows, dim), Vectors.of(_unpack(shared.value), dim)
        lists = rows.column("targets").combine_chunks()
        flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        lo, hi = (flat.field(x).to_numpy() for x in ("lo", "hi"))
        floor = np.full(len(owner), LEAST, np.int64)
        groups = rows.column("group").to_numpy()
        for g in np.unique(groups):
            members, own = np.flatnonzero(groups == g), np.flatnonzero(groups[owner] == g)
            targets = Targets(np.searchsorted(members, owner[own]), lo[own], hi[own], same, count)
            for t, (_, points) in zip(own, walk(mine.take(members), known, targets, floor[own], cfg.chunk, exact)):
                if len(points) == count:
                    floor[t] = points[-1]
        made = pa.StructArray.from_arrays([*(flat.field(x) for x in ("tag", "lo", "hi")), pa.array(floor)],
                                          names=["tag", "lo", "hi", "floor"])
        table = rows.select(names).append_column("targets", pa.ListArray.from_arrays(lists.offsets, made))
        return pa.table({"a": rows.column("a")[:1], "pack": pa.array([_pack(table)], pa.binary())})
    return anchors.select("a", *names, "targets").groupBy("a").applyInArrow(run, "a int, pack binary")


def hard_negatives(rows: DataFrame, is_anchor: Column, cfg: HardNegatives = HardNegatives(),
                   id_col: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows with
    ``id_col``, label and vector (array of integers); ``is_anchor`` is a condition on them."""
    spark = rows.sparkSession
    base = written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                               F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>")
                               .alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negatives-rows")
    most = F.array_max(F.transform("vector", F.abs))
    n, n_anchors, dim, largest = base.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector")),
                                          F.max(most)).first()
    dim, largest = max(dim or 0, 1), int(largest or 0)
    if largest * largest * dim >= 1 << 62:
        raise ArithmeticError("inner products of these components may not fit 64-bit integers")
    exact = largest * largest * dim < 1 << 52
    named = ["row", "id", "label", "vector"]
    sample = base.select(*named).orderBy(F.xxhash64("row"), "row").limit(cfg.sample).toArrow().combine_chunks()
    heads = centres(Vectors.of(sample, dim).at, cfg.clusters, cfg.rounds)
    shared = spark.sparkContext.broadcast(heads)

    def clustered(batches):
        for batch in batches:
            own = (units(Vectors.of(batch, dim).at) @ shared.value.T).argmax(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*named, "cluster"])
    anchors = written(base.where("anchor").select(*named).mapInArrow(
        clustered, "row bigint, id bigint, label bigint, vector array<bigint>, cluster int"), "negatives-anchors")

    # groups of a cluster by hash, packs of groups side by side: numbers of clusters only on the driver
    size = np.zeros(len(heads), np.int64)
    for r in anchors.groupBy("cluster").count().collect():
        size[r["cluster"]] = r["count"]
    parts, before = -(-size // cfg.group_rows), np.cumsum(size) - size
    of = lambda a: F.element_at(F.array(*[F.lit(int(x)) for x in a]), F.col("cluster") + 1)
    n_packs, n_blocks = max(-(-n_anchors // cfg.pack_rows), 1), max(-(-n // cfg.block_rows), 1)
    part = F.pmod(F.xxhash64("row"), F.greatest(of(parts), F.lit(1)))
    grouped = anchors.withColumn("part", part).withColumn(
        "a", F.least(F.floor((of(before) + F.col("part") * cfg.group_rows) / cfg.pack_rows), F.lit(n_packs - 1)).cast("int")
    ).withColumn("group", F.col("part") * len(heads) + F.col("cluster"))

    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({"c": rows.column("c")[:1], "block": pa.array([_pack(rows.select(named))], pa.binary())})
    blocks = written(base.select(*named, F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("c"))
                     .groupBy("c").applyInArrow(pack, "c int, block binary"), "negatives-blocks")

    def best(found: DataFrame, count: int) -> DataFrame:
        order = Window.partitionBy("anchor_row", "tag").orderBy(
            F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)

    def searched(with_targets: DataFrame, same: bool) -> DataFrame:
        packs = written(_packs(with_targets, _pack(sample), cfg, dim, exact, same), "negatives-packs")
        return _cells(packs, blocks, n_packs, n_blocks, cfg, dim, exact, same)
    kind = "array<struct<tag:int,lo:bigint,hi:bigint>>"
    one = F.array(F.struct(F.lit(0).alias("tag"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))).cast(kind)
    positives = written(best(searched(grouped.withColumn("targets", one), True), cfg.positives), "negatives-positives")
    p = F.col("score")
    # the least and the highest whole scores between the percentages
    lo, hi = F.expr(f"-((-score * {cfg.low} - pmod(-score * {cfg.low}, 100L)) div 100L)"), \
        F.expr(f"(score * {cfg.high} - pmod(score * {cfg.high}, 100L)) div 100L")
    wanted = positives.select("anchor_row", F.struct(F.col("rank").alias("tag"), lo.alias("lo"), hi.alias("hi")).alias("t")) \
        .groupBy("anchor_row").agg(F.collect_list("t").cast(kind).alias("targets"))
    again = grouped.join(wanted, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    negatives = best(searched(again, False), cfg.negatives)
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (negatives.select("anchor_row", "tag", F.col("rank"), F.col("id").alias("negative_id"),
                             F.col("score").alias("negative_score"))
            .join(positives.select("anchor_row", F.col("rank").alias("tag"), F.col("id").alias("positive_id"),
                                   p.alias("positive_score")), ["anchor_row", "tag"])
            .join(names, "anchor_row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
