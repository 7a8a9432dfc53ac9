"""Scores of clusterings and classifications, as aggregates; only k x k tables reach the driver."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import correlation


def contingency(df: DataFrame, truth: str = "label", guess: str = "cluster") -> DataFrame:
    """truth, guess, n, share of the truth's rows."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def matched_accuracy(df: DataFrame, truth: str = "label", guess: str = "cluster") -> tuple[float, dict]:
    """Accuracy under the best one-to-one naming of the clusters, and that naming; for up to eight classes."""
    rows = contingency(df, truth, guess).collect()
    names, found = sorted({r["truth"] for r in rows}), sorted({r["guess"] for r in rows})
    n = {(r["truth"], r["guess"]): r["n"] for r in rows}
    size = max(len(names), len(found))
    if size > 8:
        raise ValueError("more than eight classes")
    total, slots = sum(n.values()), names + [None] * (size - len(names))
    best = max(permutations(slots), key=lambda p: sum(n.get((t, g), 0) for t, g in zip(p, found, strict=False)))
    hit = sum(n.get((t, g), 0) for t, g in zip(best, found, strict=False))
    return (hit / total if total else 0.0), dict(zip(found, best, strict=False))


def adjusted_rand(df: DataFrame, truth: str = "label", guess: str = "cluster") -> DataFrame:
    """One row: ari, by pair counts of the contingency table."""
    pairs = lambda c: c * (c - 1) / 2
    n = contingency(df, truth, guess)
    cells = n.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    rows = n.groupBy("truth").agg(F.sum("n").alias("a")).agg(F.sum(pairs(F.col("a"))).alias("i"))
    columns = n.groupBy("guess").agg(F.sum("n").alias("b")).agg(F.sum(pairs(F.col("b"))).alias("j"))
    one = cells.crossJoin(rows).crossJoin(columns)  # one row each
    expected = F.col("i") * F.col("j") / pairs(F.col("n"))
    return one.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def precision_recall(df: DataFrame, truth: str = "label", guess: str = "cluster") -> DataFrame:
    """class, precision, recall, f1, with denominators of one row at least."""
    n = contingency(df, truth, guess)
    right = n.where(F.col("truth") == F.col("guess")).select(F.col("truth").alias("class"), F.col("n").alias("tp"))
    have = n.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("p"))
    said = n.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("q"))
    j = have.join(said, "class", "left").join(right, "class", "left")
    tp = F.coalesce("tp", F.lit(0))
    precision, recall = tp / F.greatest(F.coalesce("q", F.lit(0)), F.lit(1)), tp / F.greatest("p", F.lit(1))
    return j.select("class", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("f1"))


def average_ranks(df: DataFrame, column: str, name: str, by: list[str]) -> DataFrame:
    """Add ranks within groups of bounded size; ties have their mean rank."""
    order, ties = Window.partitionBy(*by).orderBy(column), Window.partitionBy(*by, column)
    return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def sums_before(df: DataFrame, order: str, values: list[str], parts: int = 256) -> DataFrame:
    """Add `<value>_before`: the sum of each value over rows of lesser `order`, which is distinct.

    Rows are dealt into ranges by approximate quantiles, so no task orders them all; ranges before a row's add their totals.
    """
    edges = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / parts for i in range(1, parts)], 0.001)))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e < F.col(order)))
    rows = df.withColumn("_part", place)
    totals = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows at most
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values]
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, *own)


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: area under the ROC curve. Equal scores are counted together first."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    return sums_before(counts, "s", ["q"]).agg((F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def roc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """score, tpr, fpr, with the rows of that score and above counted as positive."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    every = counts.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    rows = sums_before(counts, "score", ["p", "q"]).crossJoin(F.broadcast(every))  # one row
    return rows.select("score", (1 - F.col("p_before") / F.col("_p")).alias("tpr"), (1 - F.col("q_before") / F.col("_q")).alias("fpr"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(correlation(F.col("_rx"), F.col("_ry"), 0.0).alias("rho"))


def exploded(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """One row a vector component: keep, j, x."""
    return df.select(*keep, F.posexplode(vector).alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    return exploded(df, vector, label).groupBy(label, "j").agg(F.avg("x").alias("m"))


def eta_squared(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Between-group share of the variance of a value."""
    parts = df.groupBy(*by, group).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    total, between = q - s * s / n, F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - s * s / n
    return parts.groupBy(*by).agg((between / (total + 1e-12)).alias("eta2"))


def best_k(df: DataFrame, k: str, score: str, by: list[str]) -> DataFrame:
    """For each group the least k of greatest score, and that score; NaN and null scores don't count, and without any other the least k."""
    known = F.when(~F.isnan(score), F.col(score))
    best = F.max_by(F.struct(F.col(k).alias("k"), known.alias("s")), F.when(known.isNotNull(), F.struct(known.alias("s"), (-F.col(k)).alias("k"))))
    out = df.groupBy(*by).agg(best.alias("b"), F.min(k).alias("least"))
    return out.select(*by, F.coalesce("b.k", "least").alias(k), F.col("b.s").alias(score))


def nearest_centroid(df: DataFrame, vector: str, label: str, key: str, train: DataFrame | None = None) -> DataFrame:
    """key, label and guess: the label of the nearest mean vector (of train's, if given); ties go to the least label. The means, one a label, are broadcast."""
    means = centroids(df if train is None else train, vector, label).groupBy(F.col(label).alias("guess")).agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("c")).select("guess", F.col("c.m").alias("c"))
    table = means.agg(F.collect_list(F.struct("guess", "c")).alias("means"))
    rows = df.select(key, label, vector).crossJoin(F.broadcast(table))  # the table is one row
    near = F.array_min(F.transform("means", lambda m: F.struct(F.round(F.aggregate(F.zip_with(F.col(vector), m["c"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x), 9).alias("d"), m["guess"].alias("guess"))))
    return rows.select(key, label, near["guess"].alias("guess"))


def silhouette(df: DataFrame, vector: str, label: str, key: str, block: int = 32768) -> DataFrame:
    """One row: the mean Euclidean silhouette over all pairs of rows; see silhouettes."""
    return silhouettes(df, vector, [label], key, block).withColumnRenamed(label, "silhouette")


def silhouettes(df: DataFrame, vector: str, labels: list[str], key: str, block: int = 32768) -> DataFrame:
    """One row: for each column of labels, the mean Euclidean silhouette over all pairs of rows; distances are worked out once for all of them.

    Rows are dealt into blocks of about `block` by a hash of their key (fewer, if they are long), each packed as one matrix. Each pair of
    blocks is a task, which sums both blocks' distances by label; a block's sums are then added up. Rows of one key aren't compared;
    null keys are left out; null vectors, and those with values that aren't finite numbers or of lesser length, have no distance.
    """
    names = [f"l{i}" for i in range(len(labels))]
    rows = df.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(labels, names, strict=True)], F.col(vector).cast("array<double>").alias("v")).where(F.col("k").isNotNull())
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), *[F.array_sort(F.collect_set(n)).alias(n) for n in names]).first()
    width, ends = max(facts["width"] or 0, 0), np.cumsum([0, *[len(facts[n]) for n in names]])
    most = max(256, min(block, (2 << 20) // max(width, 1), (4 << 20) // max(int(ends[-1]), 1)))
    blocks = max(1, -(-facts["n"] // most), min(16, -(-facts["n"] // 512)))
    codes = [(F.coalesce(F.array_position(F.array(*[F.lit(v) for v in facts[n]]).cast(T.ArrayType(rows.schema[n].dataType)), F.col(n)), F.lit(0)) - 1).cast("int").alias(n) for n in names]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([v if v is not None and len(v) == width else np.full(width, np.nan) for v in pdf["v"]], float).reshape(len(pdf), width)
        x[~np.isfinite(x).all(1)] = np.nan
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "x": [x.tobytes()], "codes": [pdf[names].to_numpy(np.int32).tobytes()], "keys": [pd.factorize(pdf["k"])[0].astype(np.int32).tobytes()]})

    def unpacked(x: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, which of them have distances, and 1.0 at the place of each label of those that have."""
        code = np.frombuffer(codes, np.int32).reshape(-1, len(names))
        v = np.frombuffer(x, float).reshape(len(code), width)
        known = ~np.isnan(v).any(1)
        ones = np.zeros((len(code), ends[-1]))
        for i in range(len(names)):
            at = np.flatnonzero(known & (code[:, i] >= 0))
            ones[at, ends[i] + code[at, i]] = 1
        return np.where(known[:, None], v, 0), known, ones

    def sums(pair: pd.DataFrame) -> pd.DataFrame:
        alone = len(pair) == 1
        one, other = pair.iloc[0], pair.iloc[-1]
        if alone and one["pair"] // blocks != one["pair"] % blocks:
            return pd.DataFrame({"block": pd.Series([], dtype=int), "s": [], "n": [], "codes": [], "keys": [], "known": []})  # the other block has no rows
        (x, known, mine), (y, known_y, theirs) = unpacked(one["x"], one["codes"]), unpacked(other["x"], other["codes"])
        keys, centre = np.frombuffer(one["keys"], np.int32), x.mean(0)
        x, y = x - centre, y - centre
        p = np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))])
        q = np.column_stack([y, np.ones(len(y)), (y * y).sum(1)])
        s, s_y = np.zeros(mine.shape), np.zeros(theirs.shape)
        for i in range(0, len(p), 512):
            for j in range(0, len(q), 512):
                d = p[i : i + 512] @ q[j : j + 512].T
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if alone:
                    d[keys[i : i + 512, None] == keys[j : j + 512]] = 0
                else:
                    s_y[j : j + 512] += d.T @ mine[i : i + 512]
                s[i : i + 512] += d @ theirs[j : j + 512]
        s[~known], s_y[~known_y] = 0, 0
        out = [(one["block"], s.tobytes(), theirs.sum(0).tobytes(), *((one["codes"], one["keys"], known.tobytes()) if alone else (None, None, None)))]
        if not alone:
            out.append((other["block"], s_y.tobytes(), mine.sum(0).tobytes(), None, None, None))
        return pd.DataFrame(out, columns=["block", "s", "n", "codes", "keys", "known"])

    def scores(parts: pd.DataFrame) -> pd.DataFrame:
        own = parts[parts["keys"].notna()].iloc[0]
        keys, code = np.frombuffer(own["keys"], np.int32), np.frombuffer(own["codes"], np.int32).reshape(-1, len(names))
        s, n = (np.sum([np.frombuffer(v, float) for v in parts[c]], axis=0) for c in ("s", "n"))
        s, known = s.reshape(len(keys), ends[-1]), np.frombuffer(own["known"], bool)
        same = np.zeros((keys.max() + 1, ends[-1]))
        for i in range(len(names)):
            at = np.flatnonzero(known & (code[:, i] >= 0))
            np.add.at(same, (keys[at], ends[i] + code[at, i]), 1)
        n = np.where(known[:, None], n - same[keys], 0)
        out: dict[str, list] = {}
        for i, name in enumerate(names):
            # Rows of one key and label are one row.
            group, at = np.unique(np.column_stack([keys, code[:, i]]), axis=0, return_inverse=True)
            total, count = np.zeros((len(group), ends[i + 1] - ends[i])), np.zeros((len(group), ends[i + 1] - ends[i]))
            np.add.at(total, at.ravel(), s[:, ends[i] : ends[i + 1]])
            np.add.at(count, at.ravel(), n[:, ends[i] : ends[i + 1]])
            mean = np.where(count > 0, total / np.maximum(count, 1), np.inf)
            label, row = group[:, 1], np.arange(len(group))
            a = np.full(len(group), np.inf)
            a[label >= 0] = mean[row, label][label >= 0]
            mean[row[label >= 0], label[label >= 0]] = np.inf
            b = mean.min(1, initial=np.inf)
            both = np.isfinite(a) & np.isfinite(b)
            top = np.where(both, np.maximum(a, b), 1)
            out[f"{name}_s"] = [float(((b[both] - a[both]) / np.where(top > 0, top, 1)[both]).sum())]
            out[f"{name}_n"] = [int((top > 0).sum())]
        return pd.DataFrame(out)

    packed = rows.select("k", *codes, "v", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").applyInPandas(pack, "block int, x binary, codes binary, keys binary")
    a, b = F.least("block", "other"), F.greatest("block", "other")
    pairs = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).withColumn("pair", (a * blocks + b).cast("int")).drop("other")
    found = pairs.repartition(min(1000, blocks * (blocks + 1) // 2), "pair").groupBy("pair").applyInPandas(sums, "block int, s binary, n binary, codes binary, keys binary, known binary")
    kinds = ", ".join(f"{n}_s double, {n}_n bigint" for n in names)
    each = found.groupBy("block").applyInPandas(scores, kinds)
    return each.agg(*[F.try_divide(F.sum(f"{n}_s"), F.sum(f"{n}_n")).alias(c) for c, n in zip(labels, names, strict=True)])


def calinski_harabasz(df: DataFrame, vector: str, label: str) -> DataFrame:
    """One row: between over within dispersion, each by its degrees of freedom."""
    parts = exploded(df, vector, label).groupBy("j", label).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = parts.groupBy("j").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("b"))
    return whole.agg((F.sum("b") / (F.max("k") - 1) / (F.sum("w") / (F.max("n") - F.max("k")))).alias("ch"))


def davies_bouldin(df: DataFrame, vector: str, label: str) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of spreads to centroid distance."""
    means = centroids(df, vector, label)
    gaps = exploded(df.withColumn("_k", F.monotonically_increasing_id()), vector, "_k", label).join(F.broadcast(means), [label, "j"])
    spread = gaps.groupBy("_k", label).agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("d")).groupBy(label).agg(F.avg("d").alias("s"))
    a, b = means.select(F.col(label).alias("a"), "j", F.col("m").alias("ma")), means.select(F.col(label).alias("b"), "j", F.col("m").alias("mb"))
    apart = a.join(b, "j").where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))).alias("d"))
    ratio = apart.join(spread.select(F.col(label).alias("a"), F.col("s").alias("sa")), "a").join(spread.select(F.col(label).alias("b"), F.col("s").alias("sb")), "b")
    return ratio.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("d")).alias("r")).agg(F.avg("r").alias("db"))


def hopkins(df: DataFrame, probes: DataFrame, vector: str, key: str) -> DataFrame:
    """One row: sum of the probes' distances to their nearest row, over that plus the picked rows' distances to their nearest other row.

    probes: (probe, v, own): `own` is the key of a picked row, or null for a made-up place. They are few, and broadcast.
    """
    distance = F.sqrt(F.aggregate(F.zip_with(F.col("v"), F.col(vector), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    near = df.join(F.broadcast(probes), F.col("own").isNull() | (F.col("own") != F.col(key))).groupBy("probe", F.col("own").isNull().alias("made")).agg(F.min(distance).alias("d"))
    return near.agg((F.sum(F.when(F.col("made"), F.col("d"))) / F.sum("d")).alias("hopkins"))


def bimodality(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sarle's coefficient with its sample correction, and without it."""
    x = F.col(value)
    n, m = F.count(x), F.avg(x)
    s2, s3, s4 = F.sum(x * x), F.sum(x * x * x), F.sum(x * x * x * x)
    v = s2 / n - m * m
    third = s3 / n - 3 * m * s2 / n + 2 * m * m * m
    fourth = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    g, k = third / F.pow(v, F.lit(1.5)), fourth / (v * v)
    return df.groupBy(*by).agg(((g * g + 1) / (k - 3 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).alias("bc"), ((g * g + 1) / (k + 1e-6)).alias("bc_raw"))
