"""Embedding near-duplicates by small-world graphs per shard.

Vectors of one label are dealt into shards of bounded size and bytes; each shard becomes one graph, written to the shared
folder as a row. Queries are all vectors, in bounded blocks; every block meets every shard of its label. A task gets one shard
and then, one after another, some of the blocks, so a shard is loaded once for all of these, and a label with a third of all rows is
spread over its shards and parts of its blocks. In each meeting the beam widens until an audit against brute force passes (links and nearest
ten): the audited queries are drawn, evenly spaced, from those that each round would settle. A query half of whose beam are links
may have more, and one that does not find itself in its own shard was led astray, so their beams widen further and at last an exact scan of
the shard replaces it. Similarities are verified in double precision. A meeting returns each query's link
count and a spanning forest of its links, never all pairs; the forests are united by ``components``.

Edge cases: null, zero and empty vectors and vectors with null or non-finite components link with nothing, like
rows whose label or id is null; vectors of different length don't compare; rows that repeat an id stand for one node with all their vectors
(its links are the other ids that any of them links with, counted once a label), and equal rows for one vector; ties in similarity link or not
alike; vectors of any length are handled, with smaller shards; a label that is no text is compared by its text; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.hnsw import SmallWorld
from tidemark.llm.storage import drop, materialize

#: Vectors and bytes (in double precision) of a shard and of a block of queries at most (about; they are dealt by hash).
SHARD_VECTORS, SHARD_BYTES = 16_384, 64 << 20
BLOCK_VECTORS, BLOCK_BYTES = 4_096, 16 << 20
#: Blocks that meet a shard in one task.
BLOCKS_A_LOAD = 8
#: Shares of true links and of the nearest ten that an audit must find, its queries per meeting, the widest beam before exact scans.
AUDIT_RECALL, AUDIT_NEAREST = 0.99, 0.9
AUDIT_QUERIES = 64
WIDEST_BEAM = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _in_order(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, by id and then by a hash of the vector: the same in shards and in blocks."""
    pdf = pdf.sort_values(["id", "vkey"], kind="stable")
    return pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy())


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids, raw = _in_order(pdf)
    blob = pickle.dumps((ids, raw, SmallWorld(unit(raw).astype(np.float32))), protocol=5)
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "blob": [blob]})


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "block": [key[2]], "blob": [pickle.dumps(_in_order(pdf), protocol=5)]})


def find_links(
    graph: SmallWorld, base: np.ndarray, q: np.ndarray, threshold: float, own: np.ndarray | None = None, tally: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row in ``q`` and row in ``base`` of every pair found with a double-precision cosine >= threshold.

    ``own`` gives the row in ``base`` of a query that is in the shard itself, else -1: a query that does not find itself
    was led astray (a dense group can fill its beam) and is repeated with a wider beam. ``tally`` gets the true and the found links of
    the audits that passed.
    """
    own = np.full(len(q), -1) if own is None else own
    low = threshold - 1e-4  # graph similarities are single precision
    q32, n = q.astype(np.float32), len(base)
    beam, todo = 48, np.arange(len(q))
    out_q, out_b = [], []
    while len(todo):
        if beam > WIDEST_BEAM or beam >= n:
            for i in range(0, len(todo), 512):
                r, b = np.nonzero(q32[todo[i : i + 512]] @ graph.x.T >= low)
                out_q.append(todo[i : i + 512][r])
                out_b.append(b)
            break
        ids, sims = graph.search(q32[todo], beam)
        hit = (sims >= low) & (ids >= 0)
        full = (2 * hit.sum(1) >= beam) | ((own[todo] >= 0) & ~(ids == own[todo][:, None]).any(1))
        settled = np.flatnonzero(~full)
        if len(settled):
            audit = settled[np.unique(np.linspace(0, len(settled) - 1, min(AUDIT_QUERIES, len(settled))).astype(int))]
            true = q32[todo[audit]] @ graph.x.T
            links, found = int((true >= low).sum()), int(hit[audit].sum())
            tenth = np.partition(true, n - min(10, n), axis=1)[:, n - min(10, n)] - 1e-6
            nearest = (sims[audit][:, :10] >= tenth[:, None]).sum()
            if found < AUDIT_RECALL * links or nearest < AUDIT_NEAREST * len(audit) * min(10, n):
                beam *= 2
                continue
            if tally is not None:
                tally[0], tally[1] = tally[0] + links, tally[1] + found
        r, c = np.nonzero(hit & ~full[:, None])
        out_q.append(todo[r])
        out_b.append(ids[r, c])
        todo, beam = todo[full], beam * 4
    rows, cols = np.concatenate([np.zeros(0, int), *out_q]), np.concatenate([np.zeros(0, int), *out_b])
    keep = np.zeros(len(rows), bool)
    for i in range(0, len(rows), 100_000):
        keep[i : i + 100_000] = np.einsum("ij,ij->i", q[rows[i : i + 100_000]], base[cols[i : i + 100_000]]) >= threshold
    return rows[keep], cols[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (a, b) and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return nodes, nodes[label]
        label = fresh


def _own_rows(base_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The row in a shard of each query that is in it, else -1; an id's vectors are all in one shard and one block, in the same order."""
    turn = np.arange(len(ids)) - np.searchsorted(ids, ids)
    at = np.minimum(np.searchsorted(base_ids, ids) + turn, len(base_ids) - 1)
    return np.where(base_ids[at] == ids, at, -1)


def _meet(threshold: float, id_type: pa.DataType):
    """For rows sorted by key and turn: a row with a graph loads it, the following ones with queries meet it."""
    schema = pa.schema([("id", id_type), ("links", pa.int64()), ("root", id_type), ("true", pa.int64()), ("found", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, base_ids, base, graph = None, np.zeros(0), np.zeros((0, 0)), None
        for batch in batches:
            for label, dim, shard, is_graph, blob in zip(*(batch.column(k) for k in range(5)), strict=True):
                key = (label.as_py(), dim.as_py(), shard.as_py())
                if is_graph.as_py():
                    base_ids, raw, graph = pickle.loads(blob.as_py())
                    loaded, base = key, unit(raw)
                    continue
                if key != loaded:
                    raise ValueError(f"queries of {key} without their graph")
                ids, vectors = pickle.loads(blob.as_py())
                tally = [0, 0]
                r, c = find_links(graph, base, unit(vectors), threshold, _own_rows(base_ids, ids), tally)
                pairs = pd.DataFrame({"a": ids[r], "b": base_ids[c]})
                pairs = pairs[pairs["a"] != pairs["b"]].drop_duplicates()
                a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
                nodes, roots = forest(a, b) if len(a) else (a, b)
                counts = pairs.groupby("a").size()
                links = counts.reindex(nodes, fill_value=0).to_numpy(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*nodes, None], id_type), pa.array([*links.tolist(), 0], pa.int64()), pa.array([*roots, None], id_type),
                     pa.array([0] * len(nodes) + [tally[0]], pa.int64()), pa.array([0] * len(nodes) + [tally[1]], pa.int64())],
                    schema=schema,
                )

    return run


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    shard_vectors: int = SHARD_VECTORS, block_vectors: int = BLOCK_VECTORS, report: dict[str, int] | None = None,
) -> DataFrame:
    """Per row: id, n_links, component_id and kept (id = component_id), for links of cosine >= threshold within a label.

    ``report`` gets the links that the audits knew (``true``) and those that the accepted searches had found (``found``).
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("raw"))
    kind = vectors.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    number = F.col("raw").cast("array<double>")
    fine = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("raw") > 0)
        & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(number, lambda x: x != 0)
    )
    good = rows.where(F.coalesce(fine, F.lit(False))).select("id", F.col("label").cast("string").alias("label"), number.alias("vector")).distinct()
    good = materialize(good.withColumns({"dim": F.size("vector"), "vkey": F.xxhash64("vector")}), "vectors")
    least = lambda most, size: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(size) / (8 * F.col("dim")))))
    sizes = good.groupBy("label", "dim").agg(F.count("*").alias("size"))
    sizes = sizes.withColumns({"shards": F.ceil(F.col("size") / least(shard_vectors, SHARD_BYTES)), "blocks": F.ceil(F.col("size") / least(block_vectors, BLOCK_BYTES))})
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("blocks") / BLOCKS_A_LOAD)), "sizes")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    dealt = good.join(sizes, ["label", "dim"]).withColumns({"shard": deal(1, "shards"), "block": deal(2, "blocks")})
    graphs = materialize(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, "label string, dim int, shard int, blob binary"), "shards")
    blocks = materialize(dealt.groupBy("label", "dim", "block").applyInPandas(_pack, "label string, dim int, block int, blob binary"), "blocks")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    columns = ["label", "dim", "shard", "is_graph", "blob", "part", "turn"]
    loads = graphs.join(sizes, ["label", "dim"]).withColumns({"part": to("parts"), "is_graph": F.lit(True), "turn": F.lit(-1)}).select(columns)
    meets = blocks.join(sizes, ["label", "dim"]).withColumn("shard", to("shards"))
    meets = meets.withColumns({"part": F.pmod("block", "parts").cast("int"), "is_graph": F.lit(False), "turn": F.col("block")}).select(columns)
    tasks = loads.unionAll(meets).repartition(vectors.sparkSession.sparkContext.defaultParallelism * 4, "label", "dim", "shard", "part")
    tasks = tasks.sortWithinPartitions("label", "dim", "shard", "part", "turn")
    found = materialize(tasks.mapInArrow(_meet(threshold, id_type), f"id {kind}, links long, root {kind}, true long, found long"), "found")
    if report is not None:
        totals = found.agg(F.coalesce(F.sum("true"), F.lit(0)).alias("true"), F.coalesce(F.sum("found"), F.lit(0)).alias("found")).first()
        report.update(totals.asDict())
    labels = components(found.where("id <> root"), "id", "root")
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    made = materialize(links.join(labels.withColumnRenamed("node", "id"), "id", "left"), "made")
    drop(good, sizes, graphs, blocks, found, labels)
    component = F.coalesce("component", "id")
    return rows.select("id").join(made, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
