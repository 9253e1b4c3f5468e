"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .simhash import Forest

#: Classes of one block; a task compares two blocks, 2 x 16384 x about 300 bytes for 64 dimensions.
BLOCK_ROWS = 16_384
#: Pairs estimated or recomputed at once.
CHUNK = 1 << 22


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, packed, and the correction factor <code, vector> of each.

    The code of o is sign(Ro)/sqrt(D). <code, q> / factor is an unbiased estimate of <o, q> over random rotations.
    """
    dim = vectors.shape[1]
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(dim).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim)


def threshold(factor: np.ndarray, tau: float, dim: int, epsilon: float) -> np.ndarray:
    """Least <code, q> that a q of cosine ``tau`` or more with the coded vector can have.

    Write q = c*o + s*w with w orthogonal to o: <code, q> = c*factor + s*<code, w>. Over rotations <code, w> has mean 0 and
    standard deviation sqrt((1 - factor^2) / (D - 1)), and never exceeds sqrt(1 - factor^2). ``epsilon`` standard
    deviations give the confidence bound; from sqrt(D - 1) on, the default, the bound is certain and no link is lost.
    """
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2))
    side = np.minimum(1.0, epsilon / math.sqrt(max(1, dim - 1))) * spread
    # c*factor - s*side falls below its value at tau only where c*factor - s*side still grows with c: it does for c >= tau >= 0
    return tau * factor - math.sqrt(max(0.0, 1 - tau * tau)) * side


def links_between(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factor: np.ndarray, tau: float, epsilon: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) with cosine >= tau in double precision; ``same``: a is b, and pairs come once."""
    dim = a.shape[1]
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    turned = ((a / na[:, None]) @ rotation(dim).T).astype(np.float32)
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    least = (threshold(factor, tau, dim, epsilon) - 1e-5).astype(np.float32)
    step = max(1, CHUNK // max(1, len(b)))
    for lo in range(0, len(a), step):
        start = lo if same else 0  # only b after a
        i, j = np.nonzero(turned[lo : lo + step] @ signs[start:].T >= least[start:])
        i, j = i + lo, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), CHUNK // dim):
            x, y = i[k : k + CHUNK // dim], j[k : k + CHUNK // dim]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= tau
            if exact.any():
                yield x[exact], y[exact]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes, factors = [b""] * len(sizes), np.zeros(len(sizes))
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            packed, factor = encode(flat[at[rows][:, None] + np.arange(dim)])
            factors[rows] = factor
            for r, c in zip(rows, packed):
                codes[r] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)], names=[*batch.schema.names, "code", "factor"])


def near_dups(vectors: DataFrame, tau: float = 0.98, epsilon: float = math.inf, block_rows: int = BLOCK_ROWS, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link when labels are equal and not null, vectors have one length, and the cosine in double precision is at
    least ``tau``. Equal vectors of a label form a class that counts once in the join and with its size in n_links.
    Classes of a label are dealt into blocks, and each pair of blocks is one task: the code of one side and the rotated
    vector of the other give the unbiased estimate; pairs whose bound reaches ``tau`` are recomputed exactly. Tasks
    return a count and a tree parent for each linked class, never the pairs. Work is quadratic in a label's classes (at
    the rate of a float32 matrix product); blocks bound each task, whatever share of all rows a label has.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing. A null id takes part
    and names a component only if all its ids are null; rows with equal ids stay rows of their own. Extra columns are
    ignored; an empty table gives an empty result.
    """
    double = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), double.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = rows.filter("fit").groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    coded = materialise(classes.select("cid", "label", "copies", "vector").mapInArrow(_codes, "cid long, label " + classes.schema["label"].dataType.simpleString() + ", copies long, vector array<double>, code binary, factor double"), "codes")
    dims = coded.withColumn("dim", F.size("vector"))
    blocks = dims.groupBy("label", "dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = (dims.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "copies", "vector", "code", "factor"))

    def compare(group: pa.Table) -> pa.Table:
        dim, first = group["dim"][0].as_py(), group["i"][0].as_py()
        own, same = group["own"].to_numpy(), group["i"][0] == group["j"][0]
        flat = group["vector"].combine_chunks()
        all_ = (flat.flatten() if not isinstance(flat, pa.ChunkedArray) else flat.chunk(0).flatten()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(all_), -1)
        factor, cid, copies = (group[c].to_numpy() for c in ("factor", "cid", "copies"))
        at = np.flatnonzero(own == first)
        bt = at if same else np.flatnonzero(own != first)
        n, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
        if len(at) and len(bt):
            for x, y in links_between(all_[at], all_[bt], codes[bt], factor[bt], tau, epsilon, same):
                x, y = at[x], bt[y]
                n += np.bincount(x, copies[y], len(n)).astype(np.int64) + np.bincount(y, copies[x], len(n)).astype(np.int64)
                forest.union(x, y)
        hit = np.flatnonzero(n)
        return pa.table({"cid": cid[hit], "links": n[hit], "parent": cid[forest.label[hit]]})

    found = materialise(dealt.groupBy("label", "dim", "i", "j").applyInArrow(compare, "cid long, links long, parent long"), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("parent").alias("b")))
    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("label", "vector", "low", "copies", "cid", F.coalesce("component", "cid").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").join(counts, "cid", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    fit_rows = rows.filter("fit").join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    rest = rows.filter("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return fit_rows.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
