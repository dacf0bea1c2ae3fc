"""Vector search, prototypes and allocation of categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vectors import cosine
from larkspur.operators.lists import heaviest_by_content
from larkspur.scratch import written

#: Queries that may be broadcast as one matrix; more are joined block by block.
MATRIX_QUERIES = 20_000
DEFAULT_THRESHOLD = 0.60
#: Cells of a product that a task holds at a time.
TILE = 1 << 18
#: Bins of cosines in a class, vectors of a lot of a class, and the most tasks that lots are dealt to.
BINS = 1 << 16
SIDE = 8192
MOST_TASKS = 4000


def units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column of one length; a zero vector stays zero."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, threshold: float = 0.0) -> DataFrame:
    """q_id, id, sim, rank: for each stated query (q_id, q_vec) its k nearest corpus rows (id, vec) by exact cosine.

    The queries are a stated set. A corpus partition is multiplied with the matrix of a block of queries, tile by tile, and gives
    its own best k a query, so at most k rows per query and partition are shuffled, never all pairs. Ties go to the smaller id.
    Rows of another length than the query and zero vectors have similarity 0.
    """
    found = None
    rows = queries.where("q_vec IS NOT NULL").select("q_id", "q_vec")
    n = rows.count()
    blocks = max(1, -(-n // MATRIX_QUERIES))
    id_kind, q_kind = corpus.schema["id"].dataType.simpleString(), rows.schema["q_id"].dataType.simpleString()
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block).toPandas() if blocks > 1 else rows.toPandas()  # at most about MATRIX_QUERIES rows
        if not len(own):
            continue
        dim = max(map(len, own["q_vec"]))
        own = own[own["q_vec"].map(len) == dim]
        q = np.array(own["q_vec"].tolist(), np.float64)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
        matrix = corpus.sparkSession.sparkContext.broadcast((own["q_id"].to_numpy(), q))

        def score(batches: Iterator[pd.DataFrame], matrix=matrix, dim=dim) -> Iterator[pd.DataFrame]:
            names, m = matrix.value
            best, worst = None, np.full(len(names), threshold)
            for batch in batches:
                batch = batch[batch["vec"].map(lambda v: v is not None and len(v) == dim)]
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    v = np.array(part["vec"].tolist(), np.float64)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    v, ids = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0), part["id"].to_numpy()
                    for q in range(0, len(names), 512):
                        sims = m[q : q + 512] @ v.T
                        x, y = np.nonzero(sims >= worst[q : q + 512, None])
                        if not len(x):
                            continue
                        met = pd.DataFrame({"q": x + q, "id": ids[y], "sim": sims[x, y]})
                        own = np.isin(best["q"], met["q"]) if best is not None else None
                        both = met if best is None else pd.concat([best[own], met])
                        kept = both.sort_values(["q", "sim", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
                        best = kept if best is None else pd.concat([best[~own], kept])
                        full = kept.groupby("q")["sim"].agg(["size", "min"])
                        full = full[full["size"] >= k]
                        worst[full.index] = np.maximum(full["min"], threshold)
            if best is not None:
                yield pd.DataFrame({"q_id": names[best["q"].to_numpy()], "id": best["id"].to_numpy(), "sim": best["sim"].to_numpy()})

        part = corpus.select("id", "vec").mapInPandas(score, f"q_id {q_kind}, id {id_kind}, sim double")
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.select("q_id").join(corpus.select("id"), F.lit(False)).withColumn("sim", F.lit(0.0))
    return _best(found, k)


def class_scores(queries: DataFrame, prototypes: DataFrame, skip_same_id: bool = False) -> DataFrame:
    """q_id, category, score: the mean similarity to a class of up to three prototypes, else that to the nearest one.

    With more than three, the larger of the best and the mean of the best three is the best. The queries are multiplied with
    a matrix of at most MATRIX_QUERIES prototypes at a time; a query gives one row a class for each, so pairs are never
    shuffled. `skip_same_id` leaves a query's own row (id = q_id) out.
    """
    kinds = f"q_id {queries.schema['q_id'].dataType.simpleString()}, category {prototypes.schema['category'].dataType.simpleString()}, n long, total double, most double"
    rows, found = prototypes.where("vec IS NOT NULL").select(*(["id"] if skip_same_id else []), "category", "vec"), None
    blocks = max(1, -(-rows.count() // MATRIX_QUERIES))
    lot = F.pmod(F.xxhash64("category", "vec"), F.lit(blocks))
    for block in range(blocks):
        own = rows.where(lot == block).toPandas()  # chosen prototypes, at most about MATRIX_QUERIES rows
        codes, names = pd.factorize(own["category"], use_na_sentinel=False)
        v = np.array(own["vec"].tolist(), np.float64).reshape(len(own), -1)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        unit_v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        order = np.argsort(codes, kind="stable")
        ids = own["id"].to_numpy()[order] if skip_same_id else None
        matrix = queries.sparkSession.sparkContext.broadcast((unit_v[order], codes[order], np.asarray(names), ids))

        def score(batches: Iterator[pd.DataFrame], matrix=matrix) -> Iterator[pd.DataFrame]:
            m, codes, names, ids = matrix.value
            if not len(codes):
                return
            classes, code = np.unique(codes, return_inverse=True)
            rows = int(max(16, min(512, TILE // len(classes))))
            for batch in batches:
                batch = batch[batch["q_vec"].map(lambda x: x is not None and len(x) == m.shape[1])]
                for at in range(0, len(batch), rows):
                    part = batch.iloc[at : at + rows]
                    q, q_ids = np.array(part["q_vec"].tolist(), np.float64), part["q_id"].to_numpy()
                    norm = np.linalg.norm(q, axis=1, keepdims=True)
                    q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
                    n, total, most = np.zeros((len(part), len(classes)), np.int64), np.zeros((len(part), len(classes))), np.full((len(part), len(classes)), -np.inf)
                    for lo in range(0, len(m), TILE // rows):
                        to = slice(lo, lo + TILE // rows)
                        sims = q @ m[to].T
                        own = q_ids[:, None] == ids[None, to] if ids is not None else np.zeros(sims.shape, bool)
                        first = np.flatnonzero(np.r_[True, code[to][1:] != code[to][:-1]])
                        held = code[to][first]
                        n[:, held] += np.add.reduceat(~own, first, axis=1, dtype=np.int64)
                        sims[own] = 0.0
                        total[:, held] += np.add.reduceat(sims, first, axis=1)
                        sims[own] = -np.inf
                        most[:, held] = np.maximum(most[:, held], np.maximum.reduceat(sims, first, axis=1))
                    out = pd.DataFrame({"q_id": np.repeat(q_ids, len(classes)), "category": np.tile(names[classes], len(part)), "n": n.ravel(), "total": total.ravel(), "most": most.ravel()})
                    yield out[out["n"] > 0]

        part = queries.select("q_id", "q_vec").mapInPandas(score, kinds)
        found = part if found is None else found.union(part)
    n = F.sum("n")
    return found.groupBy("q_id", "category").agg(F.when(n <= 3, F.sum("total") / n).otherwise(F.max("most")).alias("score"))


def allocate(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """q_id, category (null: none), score, runner_up, runner_up_score.

    The winner has the highest score of the classes that meet their own threshold; the runner-up is the best other class.
    """
    rows = scores.join(thresholds, "category")
    won = rows.where(F.col("score") >= F.col("threshold")).groupBy("q_id").agg(F.max(F.struct("score", "category")).alias("w"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("category"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).join(won, "q_id", "left")
    top = F.coalesce(F.col("w.category"), F.first("category").over(order))
    marked = ranked.withColumn("top", top)
    other = F.max(F.when(F.col("category") != F.col("top"), F.struct("score", "category"))).alias("r")
    out = marked.groupBy("q_id").agg(F.first("w").alias("w"), F.max("score").alias("best"), other)
    return out.select("q_id", F.col("w.category").alias("category"), F.coalesce("w.score", "best").alias("score"), F.col("r.category").alias("runner_up"), F.coalesce("r.score", F.lit(0.0)).alias("runner_up_score"))


def _class_pairs(rows: DataFrame, bins: bool, side: int) -> DataFrame:
    """The cosines of all pairs inside a class of rows (id, category, vec), counted: category, bin, n by `bins`; else category,
    sim, n of those in the bins `low` or `high` that the rows name for their class.

    A class is cut into lots of about `side` vectors and every two lots meet in one group, so a task holds two lots and a slice of
    their product, and what it has counted for one class.
    """
    more = [] if bins else ["low", "high"]
    rows = rows.withColumn("dim", F.size("vec"))
    sizes = rows.groupBy("category", "dim").agg(F.ceil(F.count("*") / side).cast("int").alias("lots"))
    groups = sizes.agg(F.sum(F.col("lots") * (F.col("lots") + 1) / 2)).first()[0] or 1
    placed = rows.join(F.broadcast(sizes), ["category", "dim"]).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))  # a row a class
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    key = ["category", "dim", "a", "b"]
    met = met.select("category", "dim", F.least("lot", "other").alias("a"), F.greatest("lot", "other").alias("b"), (F.col("lot") > F.col("other")).alias("late"), "id", "vec", *more)
    dealt = met.repartition(int(min(max(groups, 8), MOST_TASKS)), *key).sortWithinPartitions(*key, "late", "id")
    dealt = dealt.select(F.xxhash64(*key).alias("home"), "category", "late", "id", "vec", *more)

    def cosines(held: list[pa.RecordBatch]) -> Iterator[np.ndarray]:
        ids = pd.factorize(pa.Table.from_batches(held).column("id").to_pandas())[0]
        late = np.concatenate([b.column("late").to_numpy(zero_copy_only=False) for b in held])
        v = np.concatenate([units(b.column("vec")) for b in held])
        left, right = (v[~late], v[late]) if late.any() else (v, v)
        for at in range(0, len(left), 256):
            sims = left[at : at + 256] @ right.T
            yield np.nan_to_num(sims.ravel() if late.any() else sims[ids[at : at + 256, None] < ids[None, :]], nan=np.inf)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, counts = None, [], np.zeros(BINS, np.int64)

        def out(of: pa.RecordBatch, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([of.column("category").take(pa.array(np.zeros(len(n), np.int64))), pa.array(values), pa.array(n)], ["category", "bin" if bins else "sim", "n"])

        def closed() -> Iterator[pa.RecordBatch]:
            for sims in cosines(held):
                bin_ = np.clip((sims + 1) * (BINS / 2), 0, BINS - 1).astype(np.int32)
                if bins:
                    counts[:] += np.bincount(bin_, minlength=BINS)
                else:
                    hit = sims[(bin_ == held[0].column("low")[0].as_py()) | (bin_ == held[0].column("high")[0].as_py())]
                    if len(hit):
                        yield out(held[0], *np.unique(hit, return_counts=True))

        def flushed(of: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if counts.any():
                some = np.flatnonzero(counts)
                yield out(of, some.astype(np.int32), counts[some])
                counts[:] = 0

        for batch in (b for b in batches if b.num_rows):
            keys = batch.column("home").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != home and held:
                    yield from closed()
                    if held[0].column("category")[0] != part.column("category")[0]:
                        yield from flushed(held[0])
                    held = []
                home = keys[lo]
                held.append(part)
        if held:
            yield from closed()
            yield from flushed(held[0])

    kind = rows.schema["category"].dataType.simpleString()
    return dealt.mapInArrow(meet, f"category {kind}, " + ("bin int, n long" if bins else "sim double, n long"))


def class_thresholds(prototypes: DataFrame, quantile: float = 0.05, side: int = SIDE) -> DataFrame:
    """category, threshold: the low quantile of the similarities inside a class, within 0 and 1; 0.60 below two vectors.

    The quantile is exact over all pairs, and no pair is shuffled or kept: a first pass counts them in bins, which shows the one or two
    that hold the quantile's neighbours, and a second pass counts the values in these.
    """
    whole = F.col("id").isNotNull() & F.col("category").isNotNull() & ~F.coalesce(F.exists("vec", lambda x: x.isNull()), F.lit(True))
    p = prototypes.where(whole).select("id", "category", F.col("vec").cast("array<double>").alias("vec"))
    by = lambda c: Window.partitionBy("category").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    bins = _class_pairs(p, True, side).groupBy("category", "bin").agg(F.sum("n").alias("n"))
    upto = bins.withColumn("upto", F.sum("n").over(by("bin"))).withColumn("at", F.lit(quantile) * (F.sum("n").over(Window.partitionBy("category")) - 1))
    reached = lambda c: F.min(F.when(F.col("upto") > c("at"), F.col("bin")))
    places = upto.groupBy("category").agg(F.first("at").alias("at"), reached(F.floor).alias("low"), reached(F.ceil).alias("high"), F.coalesce(F.max(F.when(F.col("upto") <= F.floor("at"), F.col("upto"))), F.lit(0)).alias("before"))
    places = F.broadcast(written(places, "quantile-places"))  # a row a class
    values = _class_pairs(p.join(places.select("category", "low", "high"), "category"), False, side).groupBy("category", "sim").agg(F.sum("n").alias("n"))
    upto = values.join(places, "category").withColumn("upto", F.col("before") + F.sum("n").over(by("sim")))
    value = lambda c: F.coalesce(F.min(F.when(F.col("upto") > c("at"), F.col("sim"))), F.max("sim"))
    ends = upto.groupBy("category").agg(F.first("at").alias("at"), value(F.floor).alias("a"), value(F.ceil).alias("b"))
    low = ends.select("category", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")).alias("low"))
    every = prototypes.select("category").distinct()
    return every.join(low, "category", "left").select("category", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("low", F.lit(DEFAULT_THRESHOLD)))).alias("threshold"))


def rebuild_prototypes(samples: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prototypes, thresholds) from weighted samples (content, category, weight, seq) and vectors (content, vec)."""
    kept = heaviest_by_content(samples).join(vectors, "content").select(F.xxhash64("content").alias("id"), "category", "vec")
    return kept, class_thresholds(kept)


def calibrate(prototypes: DataFrame) -> DataFrame:
    """category, own_p25, rival_p75, threshold: leave-one-out scores of prototypes (id, category, vec) by class."""
    per = class_scores(prototypes.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), prototypes, skip_same_id=True).withColumnRenamed("category", "class")
    own = prototypes.select(F.col("id").alias("q_id"), "category")
    same = F.col("class").eqNullSafe(F.col("category"))
    each = per.join(own, "q_id").groupBy("q_id", "category").agg(F.max(F.when(same, F.col("score"))).alias("own"), F.max(F.when(~same, F.col("score"))).alias("rival"))
    out = each.groupBy("category").agg(F.percentile("own", F.lit(0.25)).alias("own_p25"), F.percentile("rival", F.lit(0.75)).alias("rival_p75"))
    return out.withColumn("threshold", F.greatest("own_p25", "rival_p75"))


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their vectors (id, vec); null where one has none."""
    left = vectors.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").withColumn("cosine", F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), cosine(F.col("va"), F.col("vb")))).drop("va", "vb")
