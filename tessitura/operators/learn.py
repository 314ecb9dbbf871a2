"""Regression and classification: design matrices never leave their Gramian; folds and classes run as groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.operators import neighbours as N
from tessitura.operators.samples import KEY, toeplitz
from tessitura.operators.statistics import _ranges, digamma_int, exact_percentiles, knn_entropy
from tessitura.session import shared_table

#: Rows that permutation tests take at most: their measures are quadratic.
KNN_ROWS = 20_000


def gramian(design: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X, X'y, y'y, n) of a long design matrix (n, column, value) and (n, y): p x p sums, whatever the number of rows."""
    rows = design.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("row")).join(target, "n")
    size = (design.agg(F.max("column")).first()[0] or 0) + 1

    def partial(batches):
        g, b, yy, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
        for pdf in batches:
            x = np.zeros((len(pdf), size))
            for i, row in enumerate(pdf["row"]):
                for c, v in dict(row).items():
                    x[i, c] = v
            y = pdf["y"].to_numpy()
            g, b, yy, n = g + x.T @ x, b + x.T @ y, yy + y @ y, n + len(y)
        flat = np.concatenate([g.ravel(), b, [yy, n]])
        yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

    flat = np.zeros(size * size + size + 2)
    for k, v in rows.select("row", "y").mapInPandas(partial, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        flat[k] = v
    return flat[: size * size].reshape(size, size), flat[size * size : -2], float(flat[-2]), int(flat[-1])


def convolution_model(samples: DataFrame, target: DataFrame, lags: list[int], group: str | None = None) -> L.ConvolutionModel:
    """The least squares of (n, y) on lagged channels and a constant, as sums; lags don't cross groups."""
    return L.ConvolutionModel(*gramian(toeplitz(samples, lags, True, group), target))


def strf_ridge(samples: DataFrame, target: DataFrame, lags: list[int], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(filter of channels x lags, bias) by ridge regression with a free intercept."""
    m = convolution_model(samples, target, lags)
    sums = m.gram[-1, :-1]
    g = m.gram[:-1, :-1] - np.outer(sums, sums) / m.n
    w = L.ridge(g, m.xty[:-1] - sums * m.xty[-1] / m.n, alpha)
    return w.reshape(-1, len(lags)), float((m.xty[-1] - sums @ w) / m.n)


def strf_lasso(samples: DataFrame, target: DataFrame, lags: list[int], l1: float = 1.0, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """The same by the elastic net; the bias is penalised like any weight."""
    m = convolution_model(samples, target, lags)
    w = K.elastic_net(m.gram, m.xty, l1, l2)
    return w[:-1].reshape(-1, len(lags)), float(w[-1])


def whiten(signals: DataFrame, order: int) -> DataFrame:
    """(signal_id, n, x): residual of the least-squares prediction from the last ``order`` samples.

    Products are summed per signal, one small system each is solved in Arrow batches, and the weights come back in a join.
    """
    w = Window.partitionBy(KEY).orderBy("n")
    cols = signals.select(KEY, "n", (F.col("x") - F.avg("x").over(Window.partitionBy(KEY))).alias("x"))
    cols = cols.select("*", *[F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, order + 1)]).filter(F.col(f"l{order}").isNotNull())
    names = [f"l{k}" for k in range(1, order + 1)]
    gram = F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names])
    sums = cols.groupBy(KEY).agg(gram.alias("gram"), F.array(*[F.sum(F.col(a) * F.col("x")) for a in names]).alias("xty"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, xty: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(g, (order, order)), b, rcond=None)[0] for g, b in zip(gram, xty, strict=True)])

    fits = sums.select(KEY, solve("gram", "xty").alias("w"))
    guess = sum((F.col("w")[i] * F.col(a) for i, a in enumerate(names)), F.lit(0.0))
    return cols.join(fits, KEY).select(KEY, "n", (F.col("x") - guess).alias("x"))


def _product_sums(rows: DataFrame, keys: list[str], width: int, project=None) -> dict[tuple, np.ndarray]:
    """For each value of the keys, sums of (1, x) (1, x)' over (keys, x array), x projected first if asked: (width + 1)^2 numbers."""
    size = width + 1

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)
            own = np.hstack([np.ones((len(pdf), 1)), x if project is None else project(x)])
            for key, at in pdf.groupby(keys).indices.items() if keys else [((), np.arange(len(pdf)))]:
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0) + own[at].T @ own[at]
        for key, g in held.items():
            yield pd.DataFrame({**{k: [v] * g.size for k, v in zip(keys, key, strict=True)}, "_k": np.arange(g.size), "_v": g.ravel()})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_k long", "_v double"])
    out: dict[tuple, np.ndarray] = {}
    for r in rows.select(*keys, "x").mapInPandas(run, schema).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v")).collect():
        out.setdefault(tuple(r[k] for k in keys), np.zeros(size * size))[r["_k"]] = r["_v"]
    return {k: v.reshape(size, size) for k, v in out.items()}


def discriminate(rows: DataFrame, folds: int = 5, least: int = 5, components: int | None = None, pca_in_fold: bool = False, forest: bool = False) -> DataFrame:
    """(method, truth, predicted, p, count): soft confusion of (id, x array, label) by cross-validated LDA and QDA with even priors.

    p is the mean probability of a class over the rows of a true one, count the rows for which it is the likeliest. Classes
    under ``least`` + 1 rows are left out. Without ``components`` PCA keeps min(D, sqrt(n / 5)). A fold's model follows from
    sums of products by fold and class, so rows are read three times and never copied or gathered; what reaches the driver is
    one small matrix for each fold and class. ``forest`` adds random forests from Spark ML.
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")
    ready = rows.filter("x is not null and label is not null").select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"), fold.alias("fold"), "id")
    sizes = {r["label"]: r["n"] for r in ready.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = sorted(c for c, n in sizes.items() if n >= least + 1)
    schema = "method string, truth string, predicted string, p double, count long"
    if len(classes) < 2:
        return rows.sparkSession.createDataFrame([], schema)
    kept = ready.filter(F.col("label").isin(classes))
    width = len(kept.select("x").first()["x"])
    by_fold = {f: g for (f,), g in _product_sums(kept.select("fold", "x"), ["fold"], width).items()}
    whole = sum(by_fold.values())
    k = components or max(1, min(width, int(np.sqrt(whole[0, 0] // 5))))

    def axes_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = g[0, 1:] / g[0, 0]
        return mean, np.linalg.eigh(g[1:, 1:] / g[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :k]

    spaces = {f: axes_of(whole - g if pca_in_fold else whole) for f, g in by_fold.items()}
    models = {}
    for f, (mean, axes) in spaces.items() if pca_in_fold else [(None, next(iter(spaces.values())))]:
        source = kept.filter(F.col("fold") != f) if pca_in_fold else kept
        own = _product_sums(source.select("fold", "label", "x"), ["fold", "label"], k, lambda x, mean=mean, axes=axes: (x - mean) @ axes)
        for test in [f] if pca_in_fold else list(spaces):
            models[test] = L.gaussian_models({c: sum((g for (fo, la), g in own.items() if la == c and fo != test), np.zeros((k + 1, k + 1))) for c in classes}, max(least, 2))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for f, at in pdf.groupby("fold").indices.items():
                model, (mean, axes) = models[f], spaces[f]
                if model is None:
                    continue
                own = pdf.iloc[at]
                own = own[own["label"].isin(model["classes"])]
                if not len(own):
                    continue
                z = (np.array(own["x"].tolist(), float) - mean) @ axes
                for method in ("LDA", "QDA"):
                    p = L.gaussian_scores(model, z, method == "LDA")
                    best = p.argmax(axis=1)
                    for truth, where in own.reset_index(drop=True).groupby("label").indices.items():
                        for j, c in enumerate(model["classes"]):
                            held[method, truth, c] = held.get((method, truth, c), 0) + np.array([p[where, j].sum(), len(where), (best[where] == j).sum()])
        yield pd.DataFrame([(*key, float(v[0]), int(v[1]), int(v[2])) for key, v in held.items()], columns=["method", "truth", "predicted", "p", "n", "count"])

    parts = kept.select("x", "label", "fold").mapInPandas(run, "method string, truth string, predicted string, p double, n long, count long")
    out = parts.groupBy("method", "truth", "predicted").agg((F.sum("p") / F.sum("n")).alias("p"), F.sum("count").alias("count"))
    if forest:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.functions import array_to_vector, vector_to_array

        vectors = kept.select("fold", "label", array_to_vector("x").alias("features"))
        index = StringIndexer(inputCol="label", outputCol="y").fit(vectors)
        names = F.array(*map(F.lit, index.labels))
        for i in range(folds):
            model = RandomForestClassifier(labelCol="y", numTrees=20, seed=1).fit(index.transform(vectors.filter(F.col("fold") != i)))
            p = model.transform(vectors.filter(F.col("fold") == i)).select("label", vector_to_array("probability").alias("q"))
            p = p.select("label", F.array_position("q", F.array_max("q")).alias("best"), F.posexplode("q").alias("c", "p"))
            own = p.select(F.lit("RF").alias("method"), F.col("label").alias("truth"), F.element_at(names, F.col("c") + 1).alias("predicted"), "p", (F.col("best") == F.col("c") + 1).cast("long").alias("count"))
            out = out.unionByName(own.groupBy("method", "truth", "predicted").agg(F.avg("p").alias("p"), F.sum("count").alias("count")))
        out = out.groupBy("method", "truth", "predicted").agg(F.avg("p").alias("p"), F.sum("count").alias("count"))
    return out


def discriminate_summary(confusion: DataFrame) -> DataFrame:
    """(method, correct, n, share, chance, p_value) of a confusion: rows whose likeliest class is theirs, against chance.

    The p-value is the upper binomial tail at one over the number of classes; one row a method, so it is found on the driver.
    """
    rows = confusion.groupBy("method").agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("count")).otherwise(0)).alias("correct"), F.sum("count").alias("n"), F.count_distinct("truth").alias("classes")).collect()
    told = [(r["method"], r["correct"], r["n"], r["correct"] / max(r["n"], 1), 1 / r["classes"], chance_p_value(r["correct"], r["n"], r["classes"])) for r in rows]
    return confusion.sparkSession.createDataFrame(told, "method string, correct long, n long, share double, chance double, p_value double")


def chance_p_value(correct: int, n: int, classes: int) -> float:
    """Upper binomial tail at chance 1 / classes."""
    return K.binomial_tail(correct, n, 1 / classes)


def complex_pca(rows: DataFrame, channels: int, k: int | None = None, zscore: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of the covariance of (re array, im array) rows, largest first."""
    return L.complex_pca(complex_moments(rows, channels, zscore)[0], k)


def complex_moments(rows: DataFrame, channels: int, zscore: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(covariance Z* Z / n, pseudo-covariance Z' Z / n) of (re array, im array) rows: real and imaginary parts z-scored apart,
    products summed in Spark."""

    def sums(batches):
        g, s, n = np.zeros((2 * channels, 2 * channels)), np.zeros(2 * channels), 0
        for pdf in batches:
            x = np.hstack([np.array(pdf["re"].tolist(), float), np.array(pdf["im"].tolist(), float)])
            g, s, n = g + x.T @ x, s + x.sum(axis=0), n + len(x)
        flat = np.concatenate([g.ravel(), s, [n]])
        yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

    d = 2 * channels
    flat = np.zeros(d * d + d + 1)
    for i, v in rows.select("re", "im").mapInPandas(sums, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        flat[i] = v
    n = flat[-1]
    mean = flat[d * d : -1] / n
    cov = flat[: d * d].reshape(d, d) / n - np.outer(mean, mean) * bool(zscore)
    if zscore:
        sd = np.sqrt(np.diag(cov) * n / (n - 1))
        cov = cov / np.outer(sd, sd)
    a, b, c = cov[:channels, :channels], cov[channels:, channels:], cov[:channels, channels:]
    return a + b + 1j * (c - c.T), a - b + 1j * (c + c.T)


def complex_transform(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Every column of (re array, im array) rows beside them, with the two as scores on the components."""
    return _complex_map(rows, vectors)


def complex_inverse(scores: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Rows back from scores, by the conjugate transpose; exact if all components are there."""
    return _complex_map(scores, np.conj(vectors).T)


def _complex_map(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    def run(batches):
        for pdf in batches:
            z = (np.array(pdf["re"].tolist(), float) + 1j * np.array(pdf["im"].tolist(), float)).reshape(len(pdf), -1)
            out = z @ matrix if len(pdf) else z
            yield pdf.assign(re=list(out.real), im=list(out.imag))

    return rows.mapInPandas(run, rows.schema)


def radial_fit(rows: DataFrame, x: str, y: str, df: int = 3, folds: int = 10, key: str = "id") -> dict[str, np.ndarray]:
    """centers, widths, weights, bias, alpha and r2 of a radial basis with a ridge, its strength by cross-validation.

    Centers are percentiles of x, widths deviations between the neighbouring centers. Folds follow from a hash of ``key``; each one's
    sums of products are df + 1 squared numbers from one pass, and everything else is solved from them. Weights are the mean
    over the folds at the best strength of 10^-2 to 10^5.
    """
    shares = [int((k + 1) * 100 / (df + 1)) / 100 for k in range(df)]
    centers = exact_percentiles(rows, x, shares)
    facts = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    edges = [facts["lo"], *centers, facts["hi"]]
    spans = rows.agg(*[F.stddev_samp(F.when((F.col(x) >= a) & (F.col(x) <= b), F.col(x))).alias(f"w{i}") for i, (a, b) in enumerate(zip(edges[:-2], edges[2:], strict=True))]).first()
    centers, widths = np.array(centers), np.array([spans[f"w{i}"] for i in range(df)], float)
    basis = [F.exp(-F.pow(F.col(x) - float(c), F.lit(2.0)) / float(w)) for c, w in zip(centers, widths, strict=True)]
    terms = [F.lit(1.0), *basis, F.col(y).cast("double")]
    wide = rows.select(F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"), *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    size = len(terms)
    sums = wide.groupBy("fold").agg(F.array(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i in range(size) for j in range(size)]).alias("g")).collect()
    parts = [np.reshape(r["g"], (size, size)) for r in sorted(sums, key=lambda r: r["fold"])]
    best = None
    for alpha in np.logspace(-2, 5, 20):
        scores, weights, biases = [], [], []
        for test in parts:
            train = sum(parts) - test
            n, s = train[0, 0], train[0, 1:]
            centred = train[1:, 1:] - np.outer(s, s) / n
            w = L.ridge(centred[:-1, :-1], centred[:-1, -1], alpha)
            b = (s[-1] - s[:-1] @ w) / n
            full = np.concatenate([[b], w, [-1.0]])
            mean = s[-1] / n
            total = test[-1, -1] - 2 * mean * test[0, -1] + mean**2 * test[0, 0]
            scores.append(1 - full @ test @ full / max(total, 1e-300))
            weights.append(w)
            biases.append(b)
        if best is None or np.mean(scores) > best["r2"]:
            best = {"alpha": alpha, "r2": float(np.mean(scores)), "weights": np.mean(weights, axis=0), "bias": float(np.mean(biases))}
    return {"centers": centers, "widths": widths, **best}


def radial_transform(x, fit: dict[str, np.ndarray]):
    """A column through a fitted radial basis."""
    terms = (float(w) * F.exp(-F.pow(x - float(c), F.lit(2.0)) / float(b)) for c, b, w in zip(fit["centers"], fit["widths"], fit["weights"], strict=True))
    return sum(terms, F.lit(fit["bias"]))


def _jittered(data: DataFrame, names: list[str], groups: list[list[str]], n: int, seed: int = 0) -> DataFrame:
    """Rows with their place in the order of ``names`` as id, raw columns r0, r1, ... and jittered ones j0, j1, ...

    The jitter is what ``learn_kernels`` adds to the sorted rows, group after group: a generator can begin at any of its numbers, so
    each task makes those of its rows.
    """
    raw, noisy = [f"r{i}" for i in range(len(names))], [f"j{i}" for i in range(len(names))]
    dealt = _ranges(data.select(*[F.col(c).cast("double").alias(r) for c, r in zip(names, raw, strict=True)]), *raw)
    sizes = dealt.groupBy("_pid").agg(F.count("*").alias("_size"))
    # one row for each range
    before = sizes.select("_pid", (F.sum("_size").over(Window.orderBy("_pid")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*raw)) - 1
    rows = dealt.withColumn("_row", place).join(F.broadcast(before), "_pid").select((F.col("_row") + F.col("_before")).alias("id"), *raw)

    def noise(start: int, count: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(seed).advance(start)).random(count)

    def run(batches):
        for pdf in batches:
            pdf = pdf.sort_values("id")
            ids, out = pdf["id"].to_numpy(), pdf[raw].to_numpy(float)
            ends = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1), len(ids)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                first = 0
                for g in (len(g) for g in groups):
                    if hi > lo:
                        out[lo:hi, first : first + g] += 1e-10 * noise(n * first + int(ids[lo]) * g, (hi - lo) * g).reshape(-1, g)
                    first += g
            yield pdf.assign(**dict(zip(noisy, out.T, strict=True)))

    return shared_table(rows.mapInPandas(run, ", ".join(["id long", *(f"{c} double" for c in [*raw, *noisy])])), "jittered")


def knn_measures(rows: DataFrame, x: list[str], y: list[str], z: list[str], k: int = 3, base: float = 2) -> DataFrame:
    """(entropy, mutual, conditional, divergence) by nearest neighbours: of x; of x and y; of these given z; of x from y.

    Columns are groups of any number of dimensions. Up to ``CELL_ROWS`` rows are one task; more are dealt over cells, and a row
    meets the cells that can matter to it, so no task holds more than two. Both ways have the same jitter and distances.
    """
    names = [*x, *y, *z]
    data = rows.select(*names).dropna()
    n = data.count()
    schema = "entropy double, mutual double, conditional double, divergence double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        a, b, c = (pdf[v].to_numpy(float) for v in (x, y, z))
        kl = L.knn_kl(a, b, k, base) if len(x) == len(y) else None
        return pd.DataFrame({"entropy": [L.knn_entropy(a, k, base)], "mutual": [L.knn_mi(a, b, k, base)], "conditional": [L.knn_cmi(a, b, c, k, base)], "divergence": [kl]})

    if n <= N.CELL_ROWS:
        return data.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, schema)
    points = _jittered(data, names, [x, y, z], n)
    at = [f"j{i}" for i in range(len(names))]
    jx, jy, jz = at[: len(x)], at[len(x) : len(x) + len(y)], at[len(x) + len(y) :]
    low = F.lit(float("-inf"))
    mean_log = F.avg(F.when(F.col("radius") > 0, F.log("radius")).otherwise(low))
    psi_n, psi_k = float(K.digamma(n)), float(K.digamma(k))

    def mean_digamma(columns: list[str], radii: DataFrame) -> float:
        counts = N.count_within(points.select("id", *columns).join(radii, "id"), points, columns)
        return counts.agg(F.avg(F.when(F.col("count") > 0, digamma_int(F.greatest("count", F.lit(1)))).otherwise(low))).first()[0]

    def radii(columns: list[str]) -> DataFrame:
        return shared_table(N.kth_distance(points, points, columns, k).withColumn("radius", F.col("radius") - 1e-15), "radii")

    entropy = psi_n - psi_k + len(x) * (np.log(2) + N.kth_distance(points, points, jx, k).agg(mean_log).first()[0])
    pair = radii([*jx, *jy])
    mutual = psi_k + psi_n - mean_digamma(jx, pair) - mean_digamma(jy, pair)
    triple = radii(at)
    conditional = psi_k + mean_digamma(jz, triple) - mean_digamma([*jx, *jz], triple) - mean_digamma([*jy, *jz], triple)
    divergence = None
    if len(x) == len(y):
        raw = [f"c{i}" for i in range(len(x))]
        own = points.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(raw)])
        other = points.select(*[F.col(f"r{len(x) + i}").alias(c) for i, c in enumerate(raw)])
        # equal rows have equal distances, so each is asked for once
        asked = shared_table(own.groupBy(*raw).agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "asked")
        near = N.kth_distance(asked, own, raw, k).join(N.kth_distance(asked, other, raw, k - 1).withColumnRenamed("radius", "far"), "id").join(asked.select("id", "copies"), "id")
        sums = near.filter("radius > 0 and far > 0").agg(F.sum(F.col("copies") * F.log(F.col("far") / F.col("radius"))) / F.sum("copies")).first()[0]
        divergence = np.log(n) - np.log(n - 1) + len(x) * (np.nan if sums is None else sums)
    values = [None if v is None else float(v / np.log(base)) for v in (entropy, mutual, conditional, divergence)]
    return rows.sparkSession.createDataFrame([tuple(values)], schema)


def discrete_information(rows: DataFrame, k: int = 3, base: float = 2) -> DataFrame:
    """(information): entropy of continuous x less its mean over the classes y, weighed by their sizes.

    Neighbours come from sorted order inside each class; classes of k rows or fewer count with the whole column's entropy. A larger
    class without an entropy, as all its neighbours are ties, adds nothing to the sum, as in SQL.
    """
    per = knn_entropy(rows.filter("x is not null"), "x", k, base, "y")
    own = F.when(F.col("n") > k, F.col("entropy")).otherwise(F.col("whole"))
    whole = knn_entropy(rows.filter("x is not null"), "x", k, base).withColumnRenamed("entropy", "whole")
    return per.crossJoin(F.broadcast(whole)).agg((F.first("whole") - F.sum(F.col("n") * own) / F.sum("n")).alias("information"))


def shuffle_test(rows: DataFrame, measure, count: int = 200, share: float = 0.95, seed: int = 0) -> DataFrame:
    """(mean, lower, upper) of measure(x, y) over seeded permutations of x, one group a permutation. ``rows``: (x, y), or (x, y, z)
    for measure(x, y, z).

    Every permutation needs all rows in one task; the measures of this package are quadratic, so more than ``KNN_ROWS`` raise.
    """
    names = [c for c in ("x", "y", "z") if c in rows.columns]
    if rows.count() > KNN_ROWS:
        raise ValueError(f"too many rows for a permutation each; {KNN_ROWS} at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(names)
        x = np.random.default_rng([seed, int(own["perm"].iloc[0])]).permutation(own["x"].to_numpy())
        return pd.DataFrame({"value": [float(measure(x[:, None], *[own[c].to_numpy()[:, None] for c in names[1:]]))]})

    values = rows.select(*names, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("perm")).groupBy("perm").applyInPandas(run, "value double")
    low = (1 - share) / 2
    return values.agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(1 - low)).alias("upper"))
