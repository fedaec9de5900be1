"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Each of several tables gives a vector the signs of its products with ``bits`` random
directions; vectors of one bucket are compared. Two vectors at cosine c agree in one sign
with chance ``1 - acos(c) / pi``, so the number of bits follows the number of vectors
(buckets of about ``bucket_rows`` by chance) and the number of tables follows from the
bits and the ``recall`` asked for at the threshold; closer pairs are found more surely.

Equal vectors are one class: one of them is hashed, the others follow and count. A bucket
is dealt out as blocks and pairs of blocks, so no task holds a bucket whole, however many
vectors are alike. A pair that shares several buckets counts in the first table only.
Blocks return sums and, for components, one link per vector to the least vector it
reaches inside the block pair; pairs of vectors never become rows.

Rows: ``vec_id``, ``n_links``, ``component_id``, ``kept``. Vectors that are null, zero, or hold
null or non-finite components link with nothing. Rows of one id are vectors of their own;
a null id is passed over when the smallest is taken. Vectors of differing lengths never
link. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.components import components
from graticule.session import written

COSINE = 0.9
RECALL = 0.999
BUCKET_ROWS = 1024
BLOCK = 2048
SEED = 31


def shape(rows: int, cosine: float, recall: float, bucket_rows: int) -> tuple[int, int]:
    """Bits and tables."""
    bits = max(1, min(62, math.ceil(math.log2(max(2, rows / bucket_rows)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _signs(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column("dims"))
            signs = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, bits * tables))
                mine = np.flatnonzero(sizes == d)
                x = _matrix(batch.column("x").take(pa.array(mine)))
                signs[mine] = ((x @ planes[d]) > 0).reshape(len(mine), tables, bits) @ weights
            flat = pa.array(signs.ravel())
            offs = pa.array(np.arange(0, signs.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "x", "dims")), pa.ListArray.from_arrays(offs, flat)],
                names=["node", "n", "x", "dims", "signs"],
            )

    return run


def _compare(cosine: float):
    """One block, or a pair of blocks, of one bucket: linked copies per vector and a link to the least of its group."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = key[0].as_py()
        part, node, n = (table.column(c).to_numpy() for c in ("part", "node", "n"))
        x = _matrix(table.column("x").combine_chunks())
        signs = np.asarray(table.column("signs").combine_chunks().flatten(), np.int64).reshape(len(x), -1)[:, :t]
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        left = np.flatnonzero(part == 0)
        right = np.flatnonzero(part == 1)
        own = not len(right)
        right = left if own else right
        label = np.arange(len(node))
        order = np.argsort(node, kind="stable")
        label[order] = np.arange(len(node))
        degree = np.zeros(len(node), np.int64)
        linked = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            hit = x[rows] @ x[right].T >= cosine
            i, j = np.nonzero(hit)
            drop = (signs[rows[i]] == signs[right[j]]).any(axis=1) if t else np.zeros(len(i), bool)
            if own:
                drop |= rows[i] >= right[j]
            hit[i[drop], j[drop]] = False
            linked[at : at + 128] = hit
        a, b = np.nonzero(linked)
        a, b = left[a], right[b]
        np.add.at(degree, a, n[b])
        np.add.at(degree, b, n[a])
        while len(a):
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = np.minimum(label, label[order[label]])
            if (label == before).all():
                break
        to = node[order[label]]
        keep = degree > 0
        return pa.table({"node": node[keep], "to": to[keep], "links": degree[keep]})

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """Links and component of every row of ``vectors(vec_id, embedding)`` (see the module's notes)."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)
    )
    kept_as = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    # -0.0 equals 0.0, so both have one key.
    x = F.transform(x, lambda v: (v + F.lit(0.0)).cast(kept_as))
    rows = written(
        vectors.select(F.col("vec_id").cast("long"), sound.alias("sound"), F.when(sound, x).alias("x"))
        .withColumn("uid", F.monotonically_increasing_id()), "vectors",
    )
    usable = rows.where("sound")
    classes = written(
        usable.groupBy("x").agg(F.min("uid").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("least_id")), "vector-classes"
    )
    member = usable.select("uid", "vec_id", "x").join(classes.select("x", "node"), "x").select("uid", "node")
    bits, tables = shape(classes.count(), cosine, recall, bucket_rows)
    hashed = written(
        classes.select("node", "n", "x", F.size("x").alias("dims")).mapInArrow(
            _signs(bits, tables, seed), f"node long, n long, x array<{kept_as}>, dims int, signs array<long>"
        ), "vector-signs",
    )
    slots = hashed.select("node", "dims", F.posexplode("signs").alias("t", "sign"))
    sizes = slots.groupBy("t", "dims", "sign").agg(F.count("*").alias("m")).where("m > 1")
    slots = slots.join(sizes, ["t", "dims", "sign"]).select(
        "node", "t", "dims", "sign", F.ceil(F.col("m") / block).cast("int").alias("blocks")
    ).withColumn("mine", F.pmod(F.xxhash64("node", "t"), "blocks").cast("int"))
    # Block i meets itself and every later block; the pair's key is (i, j), the side is the part.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"), (F.col("mine") > o).cast("int").alias("part")),
    )
    dealt = slots.select("node", "t", "dims", "sign", F.explode(meets).alias("m")).select("node", "t", "dims", "sign", "m.i", "m.j", "m.part")
    narrow = F.col("signs").cast("array<int>") if bits < 32 else F.col("signs")
    dealt = dealt.join(hashed.select("node", "n", "x", narrow.alias("signs")), "node")
    found = dealt.groupBy("t", "dims", "sign", "i", "j").applyInArrow(_compare(cosine), "node long, to long, links long")
    found = written(found.groupBy("node", "to").agg(F.sum("links").alias("links")), "vector-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    placed = classes.select("node", "n", "least_id").join(degree, "node", "left").join(label, "node", "left").select(
        "node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("c")
    )
    least = placed.groupBy("c").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(least, "c").select("node", "n_links", "component_id")
    named = member.join(placed, "node").select("uid", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.select("uid", "vec_id").join(named, "uid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
