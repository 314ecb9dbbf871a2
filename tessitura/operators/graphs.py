"""Weighted graphs as edges (src, dst, weight): strengths, modularity matrices, link rank, communities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import shared_table


def symmetric_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of an undirected graph: both directions summed, loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def strengths(weights: DataFrame) -> DataFrame:
    return weights.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))


def affinity(edges: DataFrame) -> DataFrame:
    """(src, dst, value): row-normalised symmetric weights D^-1 W. A node without weight has no row."""
    w = symmetric_weights(edges)
    return w.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("value"))


def modularity_matrix(edges: DataFrame, null_weight: float = 1.0) -> DataFrame:
    """(i, j, value): A - gamma w_i w_j / M over all node pairs; meant for graphs whose pairs are wanted, so output is n^2."""
    w = symmetric_weights(edges)
    s = strengths(w)
    s = s.crossJoin(F.broadcast(s.agg(F.sum("strength").alias("total"))))
    a = s.select(F.col("node").alias("i"), F.col("strength").alias("si"), "total")
    b = s.select(F.col("node").alias("j"), F.col("strength").alias("sj"))
    null = a.crossJoin(b).join(w.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight"), ["i", "j"], "left")
    return null.select("i", "j", (F.coalesce("weight", F.lit(0.0)) - null_weight * F.col("si") * F.col("sj") / F.col("total")).alias("value"))


def modularity(edges: DataFrame, communities: DataFrame, null_weight: float = 1.0) -> DataFrame:
    """Modularity of (node, community) without the matrix: per community its inner weight and its strength."""
    w = symmetric_weights(edges)
    s = strengths(w).join(communities, "node")
    total = F.sum("strength")
    inner = w.join(communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(communities.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = inner.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inner"))
    per = s.groupBy("community").agg(total.alias("strength")).join(inside, "community", "left")
    whole = w.agg(F.sum("weight").alias("m"))
    return per.crossJoin(F.broadcast(whole)).agg((F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - null_weight * F.pow(F.col("strength") / F.col("m"), F.lit(2.0)))).alias("modularity"))


def generalized_modularity(matrix: DataFrame, members: DataFrame, directed: bool = False) -> DataFrame:
    """The matrix over a subgroup (node), less each row's sum on the diagonal; half of the row's and the column's sum if directed."""
    sub = matrix.join(members.select(F.col("node").alias("i")), "i", "left_semi").join(members.select(F.col("node").alias("j")), "j", "left_semi")
    if not directed:
        row = F.sum("value").over(Window.partitionBy("i"))
        return sub.select("i", "j", (F.col("value") - F.when(F.col("i") == F.col("j"), row).otherwise(0.0)).alias("value"))
    both = sub.select(F.col("i").alias("node"), (F.col("value") / 2).alias("v")).unionByName(sub.select(F.col("j").alias("node"), (F.col("value") / 2).alias("v"))).groupBy("node").agg(F.sum("v").alias("v"))
    out = sub.join(both, sub["i"] == both["node"], "left")
    return out.select("i", "j", (F.col("value") - F.when(F.col("i") == F.col("j"), F.coalesce("v", F.lit(0.0))).otherwise(0.0)).alias("value"))


def google_matrix(edges: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(i, j, value) on the edges: alpha w_ij / out-strength + (1 - alpha) / n; other pairs hold the second term alone."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("n"))
    per = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).select("*", F.sum("weight").over(Window.partitionBy("src")).alias("out"))
    return per.crossJoin(F.broadcast(nodes)).select(F.col("src").alias("i"), F.col("dst").alias("j"), (alpha * F.col("weight") / F.col("out") + (1 - alpha) / F.col("n")).alias("value"))


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_semi")


def page_rank(edges: DataFrame, alpha: float = 0.85, iterations: int = 30) -> DataFrame:
    """(node, rank) by power iteration; nodes without outgoing edges spread evenly. A round reads the ranks twice,
    so the lineage is cut every second round."""
    w = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    step = shared_table(w.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share")), "steps")
    nodes = shared_table(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    n = nodes.count()
    rank = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    sinks = nodes.join(step.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("sink", F.lit(1.0))
    for i in range(iterations):
        flow = step.join(rank, step["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        lost = rank.join(sinks, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = nodes.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", (alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"))
        if i % 2:
            rank = shared_table(rank, "rank")
    return rank


def link_rank_matrix(edges: DataFrame, alpha: float = 0.85, null_weight: float = 1.0, iterations: int = 30) -> DataFrame:
    """(i, j, link, value) on the edges: link = pi_i G_ij and value = link - gamma pi_i pi_j."""
    rank = shared_table(page_rank(edges, alpha, iterations), "rank")
    g = google_matrix(edges, alpha)
    both = g.join(rank.select(F.col("node").alias("i"), F.col("rank").alias("pi")), "i").join(rank.select(F.col("node").alias("j"), F.col("rank").alias("pj")), "j")
    link = F.col("pi") * F.col("value")
    return both.select("i", "j", link.alias("link"), (link - null_weight * F.col("pi") * F.col("pj")).alias("value"))


def link_rank_modularity(edges: DataFrame, alpha: float = 0.85, null_weight: float = 1.0, iterations: int = 30) -> DataFrame:
    """(i, j, value) over all node pairs: pi_i G_ij - gamma pi_i pi_j with the teleport term everywhere; output is n^2."""
    rank = shared_table(page_rank(edges, alpha, iterations), "rank")
    n = rank.count()
    share = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share"))
    sinks = rank.select(F.col("node").alias("i")).join(share.select(F.col("src").alias("i")).distinct().withColumn("goes", F.lit(True)), "i", "left")
    a, b = rank.select(F.col("node").alias("i"), F.col("rank").alias("pi")), rank.select(F.col("node").alias("j"), F.col("rank").alias("pj"))
    pairs = a.join(sinks, "i").crossJoin(b).join(share.select(F.col("src").alias("i"), F.col("dst").alias("j"), "share"), ["i", "j"], "left")
    step = F.when(F.col("goes").isNull(), F.lit(1.0 / n)).otherwise(F.coalesce("share", F.lit(0.0)))
    return pairs.select("i", "j", (F.col("pi") * (alpha * step + (1 - alpha) / n) - null_weight * F.col("pi") * F.col("pj")).alias("value"))


# --- dense parts, for matrices of a graph that fits one machine -----------------------------------------------------


def eigenvector_partition(b: np.ndarray, directed: bool = False, swap: bool = False) -> np.ndarray | None:
    """Signs (+1, -1) of the leading eigenvector; None if no split raises modularity. ``swap`` then moves single nodes while that helps."""
    sym = (b + b.T) / 2 if directed else b
    values, vectors = np.linalg.eigh(sym)
    if values[-1] <= 1e-12:
        return None
    lead = vectors[:, -1]
    lead = lead * (1 if lead[np.argmax(np.abs(lead))] > 0 else -1)
    signs = np.where(lead > 0, 1, -1)
    while swap:
        gain = -2 * signs * (sym @ signs - np.diag(sym) * signs)
        i = int(gain.argmax())
        if gain[i] <= 1e-12:
            break
        signs[i] *= -1
    return signs


def communities(b: np.ndarray, directed: bool = False, swap: bool = False) -> list[dict]:
    """Dendrogram of recursive bisection: nodes {id, parent, members}; leaves are communities."""
    out = [{"id": "root", "parent": None, "members": list(range(len(b)))}]
    stack = [0]
    while stack:
        at = stack.pop()
        node = out[at]
        m = np.array(node["members"])
        sub = b[np.ix_(m, m)]
        rows = sub.sum(axis=1) if not directed else (sub.sum(axis=1) + sub.sum(axis=0)) / 2
        signs = eigenvector_partition(sub - np.diag(rows), directed, swap)
        if signs is None or len(set(signs.tolist())) < 2:
            continue
        for label, side in (("a", 1), ("b", -1)):
            out.append({"id": f"{node['id']}->{label}", "parent": node["id"], "members": m[signs == side].tolist()})
            stack.append(len(out) - 1)
    return out


def leaves(dendrogram: list[dict], min_size: int | None = None) -> list[list[int]]:
    """Communities of a dendrogram; where a child is smaller than ``min_size`` its parent stays whole."""
    kids: dict[str, list[dict]] = {}
    for node in dendrogram:
        kids.setdefault(node["parent"], []).append(node)

    def walk(node: dict) -> list[list[int]]:
        own = kids.get(node["id"], [])
        if not own or (min_size and any(len(k["members"]) < min_size for k in own)):
            return [sorted(node["members"])]
        return [c for k in own for c in walk(k)]

    return walk(dendrogram[0]) if dendrogram else []


def spectral_clusters(w: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels by k-means on the eigenvectors 2..k of D^-1 W (through the symmetric form)."""
    d = w.sum(axis=1)
    if (d <= 0).any():
        raise ValueError("a node has no weight")
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    order = np.argsort(-values)
    x = (vectors[:, order] / np.sqrt(d)[:, None])[:, 1:k]
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[int(far.argmax())])
    c = np.array(centers)
    for _ in range(100):
        label = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral_gaps(w: np.ndarray, powers: range = range(1, 500)) -> list[tuple[int, int, float]]:
    """(power, place, gap) of the largest step between neighbouring eigenvalues of D^-1 W, each raised to a power, largest
    first; up to the first power whose largest step comes after the first eigenvalue. The place is a number of clusters."""
    d = w.sum(axis=1)
    if (d <= 0).any():
        raise ValueError("a node has no weight")
    values = np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d)))
    values = values[np.argsort(-np.abs(values), kind="stable")]
    out = []
    for power in powers:
        steps = -np.diff(values**power)
        out.append((power, int(steps.argmax()) + 1, float(steps.max())))
        if out[-1][1] == 1:
            break
    return out


def cluster_count(gaps: list[tuple[int, int, float]]) -> int:
    """The number of clusters that lasts longest as the power grows, 1 and what only the first power says aside."""
    places = [place for _, place, _ in gaps if place > 1]
    return max(set(places), key=lambda p: (places.count(p), -p)) if places else 1


def matrix_array(matrix: DataFrame) -> tuple[np.ndarray, list]:
    """Dense array of (i, j, value) entries, others 0, and the node order, for matrices of at most 5000 nodes."""
    nodes = [r[0] for r in matrix.select(F.col("i").alias("n")).union(matrix.select("j")).distinct().orderBy("n").limit(5001).collect()]
    if len(nodes) > 5000:
        raise ValueError("too many nodes for a dense matrix")
    at = {v: i for i, v in enumerate(nodes)}
    out = np.zeros((len(nodes), len(nodes)))
    for r in matrix.select("i", "j", "value").collect():
        out[at[r["i"]], at[r["j"]]] = r["value"]
    return out, nodes


def weight_array(edges: DataFrame) -> tuple[np.ndarray, list]:
    """Dense symmetric weights and the node order, for graphs of at most 5000 nodes."""
    w = symmetric_weights(edges)
    nodes = [r[0] for r in w.select("src").distinct().orderBy("src").limit(5001).collect()]
    if len(nodes) > 5000:
        raise ValueError("too many nodes for a dense matrix")
    at = {v: i for i, v in enumerate(nodes)}
    out = np.zeros((len(nodes), len(nodes)))
    for r in w.collect():
        out[at[r["src"]], at[r["dst"]]] = r["weight"]
    return out, nodes
