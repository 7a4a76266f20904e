"""Dense retrieval, hard-negative mining, and contrastive batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import dot, unit
from lodestone.operators.position import running_last
from lodestone.plans.running import order_hash
from lodestone.plans.scratch import materialise

#: Documents of a part, which a task holds while queries stream by; pivots at most, each a document of a hashed sample.
PART, PIVOTS = 1 << 14, 256
#: Queries and documents that are multiplied at once.
ROWS, COLUMNS = 1024, 4096
#: Room for rounding in a bound.
SLACK = 1e-9


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query, ties by id: ``rank`` from 1."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _best_of(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores of each row, ties by name; only scores as good as the k-th are sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.reshape(-1) for x in np.indices(scores.shape))
    order = np.lexsort((names[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _scored(k: int, skip_self: bool):
    """The task: rows of part and kind in order, a part's documents before the queries that visit it."""

    def run(batches):
        key, names, held, documents = None, [], [], None
        for batch in batches:
            pivot, salt, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "salt", "kind", "id"))
            turns = np.flatnonzero((pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *turns], [*turns, len(ids)], strict=True):
                if a == z:
                    continue
                if key != (pivot[a], salt[a]):
                    key, names, held, documents = (pivot[a], salt[a]), [], [], None
                vectors = _matrix(batch.column("v").slice(a, z - a))
                if kind[a] == 0:
                    names.append(ids[a:z])
                    held.append(vectors)
                    continue
                if not names:
                    continue
                if documents is None:
                    documents, all_names = np.concatenate(held), np.concatenate(names)
                for at in range(0, len(vectors), ROWS):
                    asked, block = ids[a:z][at : at + ROWS], vectors[at : at + ROWS]
                    rows, found, scores = [], [], []
                    for d in range(0, len(documents), COLUMNS):
                        s, n = block @ documents[d : d + COLUMNS].T, all_names[d : d + COLUMNS]
                        if skip_self:
                            s[asked[:, None] == n[None, :]] = -np.inf
                        r, c = _best_of(s, n, k)
                        keep = s[r, c] > -np.inf
                        rows.append(r[keep])
                        found.append(n[c[keep]])
                        scores.append(s[r[keep], c[keep]])
                    yield pa.RecordBatch.from_arrays([pa.array(asked[np.concatenate(rows)]), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], ["query_id", "document_id", "score"])

    return run


def placed_documents(documents: DataFrame) -> tuple[DataFrame, np.ndarray, list[tuple[int, float, int]]]:
    """Documents at their nearest pivot, the pivots, and of each that has documents its number, greatest angle and number of parts.

    ``document_id, v, pivot, salt``: a pivot with more than ``PART`` documents has as many parts as it needs.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("document_id").cast("long").alias("document_id"), unit(F.col("vector")).alias("v"))
    n = documents.count()
    if n <= PART:
        return docs.withColumns({"pivot": F.lit(0), "salt": F.lit(0).cast("long")}), np.zeros((0, 0)), [(0, np.pi, 1)]
    sample = docs.orderBy(order_hash(F.lit("pivot"), F.col("document_id")), "document_id").limit(min(PIVOTS, -(-n // PART) * 4)).collect()
    pivots = np.array([r.v for r in sample])

    def nearest(batches):
        for b in batches:
            angles = _angles(_matrix(b.column("v")), pivots)
            at = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(angles[np.arange(len(at)), at])], ["document_id", "v", "pivot", "angle"])

    near = materialise(docs.mapInArrow(nearest, "document_id long, v array<double>, pivot int, angle double"), "placed")
    held = [(r.pivot, r.angle, -(-r.n // PART)) for r in near.groupBy("pivot").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()]
    parts = spark.createDataFrame([(p, s) for p, _, s in held], "pivot int, parts long")  # a row a pivot
    return near.join(F.broadcast(parts), "pivot").select("document_id", "v", "pivot", F.pmod(F.xxhash64("document_id"), F.col("parts")).alias("salt")), pivots, held


def _met(documents: DataFrame, pivots: np.ndarray, held: list, queries: DataFrame, first: bool) -> DataFrame:
    """``query_id, v, pivot`` of the pivots that each query (``query_id, v, least``) visits: first its nearest one, then all that may hold a better document."""
    names = np.array([h[0] for h in held], dtype=np.int32)
    radius = np.array([h[1] for h in held])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            angles = _angles(_matrix(b.column("v")), pivots[names]) if len(pivots) else np.zeros((len(b), 1))
            nearest = angles.argmin(axis=1)
            own = np.arange(len(names))[None, :] == nearest[:, None]
            if first:
                visit = own
            else:
                least = b.column("least").to_numpy(zero_copy_only=False)
                visit = ~own & (np.cos(np.maximum(angles - radius[None, :], 0.0)) + SLACK >= least[:, None])
            row, column = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(names[column])], ["query_id", "v", "pivot"])

    return queries.mapInArrow(run, "query_id long, v array<double>, pivot int")


def _visited(documents: DataFrame, held: list, met: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The ``k`` best of each query in each part of the pivots that it meets."""
    most = max((h[2] for h in held), default=1)
    salts = met.withColumn("salt", F.lit(0).cast("long"))
    if most > 1:
        parts = met.sparkSession.createDataFrame([(p, s) for p, _, s in held], "pivot int, parts long")
        salts = met.join(F.broadcast(parts), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    row = lambda kind, key: ("pivot", "salt", F.lit(kind).alias("kind"), F.col(key).alias("id"), "v")
    rows = documents.select(*row(0, "document_id")).unionByName(salts.select(*row(1, "query_id")))
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind", "id")
    return dealt.mapInArrow(_scored(k, skip_self), "query_id long, document_id long, score double")


def visits(documents: DataFrame, pivots: np.ndarray, held: list, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """``query_id, pivot`` of all visits of a search, for a look at what its bounds save."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("vector")).alias("v"), F.lit(-2.0).alias("least"))
    first = _met(documents, pivots, held, asked, True)
    return first.select("query_id", "pivot").unionByName(_met(documents, pivots, held, _reached(asked, _visited(documents, held, first, k, skip_self), k), False).select("query_id", "pivot"))


def _reached(asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The queries with the score that their k-th best document has at least."""
    least = top_k(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("l"))
    return asked.drop("least").join(least, "query_id", "left").select("query_id", "v", F.coalesce("l", F.lit(-2.0)).alias("least"))


def retrieve(queries: DataFrame, documents: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Exact top-k by cosine: ``query_id, document_id, score``; each query_id once.

    Documents are dealt once, to parts about pivots; queries travel to the parts, and never to the driver.  A query first visits
    its nearest pivot; the k-th score there rules out every pivot whose documents are all too far by the triangle inequality of
    angles.  A task holds a part and streams its queries, whose k best merge at the end.
    ``skip_self`` leaves out the document that has the query's own id.
    """
    placed, pivots, held = placed_documents(documents)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("vector")).alias("v"), F.lit(-2.0).alias("least"))
    first = _visited(placed, held, _met(placed, pivots, held, asked, True), k, skip_self) if len(held) > 1 else _visited(placed, held, asked.select("query_id", "v", F.lit(held[0][0]).alias("pivot")), k, skip_self)
    if len(held) > 1:
        first = materialise(first, "nearest")
        first = first.unionByName(_visited(placed, held, _met(placed, pivots, held, _reached(asked, first, k), False), k, skip_self))
    return top_k(first, k).drop("rank")


def mine(scored: DataFrame, labels: DataFrame, threshold: float = 0.95, negatives: int = 10, positives: int = 1) -> DataFrame:
    """``query_id, document_id, relevance``: the best positives (+1) and the hardest safe negatives (-1).

    A negative scores strictly below ``threshold`` times the least positive in use, and is no labelled
    positive; queries without exactly ``negatives`` of them are dropped.
    """
    marked = scored.join(labels.select("query_id", "document_id", F.lit(True).alias("hit")).distinct(), ["query_id", "document_id"], "left")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id")
    good = marked.filter("hit").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= positives)
    cut = good.groupBy("query_id").agg((F.min("score") * threshold).alias("cut"))
    bad = marked.filter("hit IS NULL").join(cut, "query_id").filter("score < cut").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= negatives)
    whole = bad.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == negatives).select("query_id")
    both = good.select("query_id", "document_id", F.lit(1).cast("int").alias("relevance")).unionByName(bad.select("query_id", "document_id", F.lit(-1).cast("int").alias("relevance")))
    return both.join(whole, "query_id", "left_semi")


def negative_uses(mined: DataFrame, uses: int, per_use: int, seed: int = 0) -> DataFrame:
    """Disjoint subsets of each query's negatives, one per reuse of the query: ``query_id, document_id, use``."""
    order = Window.partitionBy("query_id").orderBy(order_hash(F.lit(seed), F.col("query_id"), F.col("document_id")), "document_id")
    ranked = mined.filter("relevance < 0").withColumn("r", F.row_number().over(order) - 1)
    return ranked.withColumn("use", F.floor(F.col("r") / per_use).cast("int")).filter(F.col("use") < uses).drop("r", "relevance")


def pair_batches(pairs: DataFrame, batch: int, rows: int) -> DataFrame:
    """Positioned pairs in fixed batches with dense ids in sorted order of the raw ids; the tail is dropped."""
    whole = pairs.filter(F.col("pos") < rows - rows % batch).withColumn("batch_id", F.floor(F.col("pos") / batch))
    dense = lambda c: (F.dense_rank().over(Window.partitionBy("batch_id").orderBy(c)) - 1).cast("int")
    return whole.withColumn("batch_query_id", dense("query_id")).withColumn("batch_document_id", dense("document_id"))


def suffix_lookup(texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """For each ``text`` the ``body`` that is greatest, reversed, among those not above the reversed text, if the text ends with it.

    An as-of join by one union of distinct texts and bodies, range-partitioned, and a running last value.
    """
    a = texts.select("text").distinct().select("text", F.reverse("text").alias("k"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("body"))
    b = bodies.select("body").distinct().select(F.lit(None).cast("string").alias("text"), F.reverse("body").alias("k"), F.lit(0).alias("side"), "body")
    found = running_last(a.unionByName(b), "body", "k", "side", out="near").filter("side = 1")
    ends = found.select("text", F.when(F.col("text").endswith(F.col("near")), F.col("near")).alias("body"))
    return texts.join(ends, "text", "left").select("text_id", "body")


def info_nce(scores: DataFrame, temperature: float) -> DataFrame:
    """One loss per (query, positive): cross entropy against the query's negatives; unlabelled pairs and other positives are out.

    ``scores`` holds ``query_id, document_id, score, relevance``.
    """
    s = scores.filter("relevance <> 0").withColumn("s", F.col("score") / temperature)
    neg = s.filter("relevance < 0").groupBy("query_id").agg(F.sum(F.exp("s")).alias("others"))
    pos = s.filter("relevance > 0").join(neg, "query_id", "left")
    return pos.select("query_id", "document_id", (F.log(F.exp("s") + F.coalesce("others", F.lit(0.0))) - F.col("s")).alias("loss"))
