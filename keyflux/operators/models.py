"""One superstep of logistic regression, linear SVM and matrix factorization, and their evaluation.

Samples come as (sample_id, y, b, worker, features), features an array of
(idx, x) by rising idx; b and worker order the pushes of a superstep: of two
pushes to a key the one with the larger (b, worker) wins.  All samples of a
superstep read the weights of its start.  `compat` follows the original's
arithmetic, where it differs from the textbook's, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .kv import upsert
from .ordered import first_rows


#: Weights with keys below this are looked up in one array, sent to every task; others are joined by exchange.
DENSE_ROWS = 1_000_000


def attach(samples: DataFrame, weights: DataFrame, rows: int | None = None, bias: bool = True, prefetch: bool = False) -> DataFrame:
    """samples with w: array of (idx, x, val) by idx, and with bias w0, the value of key 0.

    rows, if known, is a number that all keys are below.  Up to DENSE_ROWS the
    weights become one array (8 bytes a key) and each feature a lookup in it;
    else features are joined with the weights by key.  prefetch first reduces
    the weights to the samples' own keys.
    """
    if rows is not None and rows <= DENSE_ROWS:
        all_ = samples.sparkSession.range(rows).select(F.col("id").alias("key")).join(weights, "key", "left")
        dense = all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", F.coalesce("val", F.lit(0.0)).alias("val")))), lambda e: e["val"]).alias("_dense"))  # DENSE_ROWS at most
        entry = lambda f: F.struct(f["idx"].cast("long").alias("key"), f["x"].alias("x"), F.coalesce(F.get("_dense", f["idx"]), F.lit(0.0)).alias("val"))
        out = samples.join(F.broadcast(dense)).withColumn("w", F.transform("features", entry)).drop("features")
        return (out.withColumn("w0", F.coalesce(F.get("_dense", F.lit(0)), F.lit(0.0))) if bias else out).drop("_dense")
    long = samples.select("sample_id", F.explode("features").alias("f")).select("sample_id", F.col("f.idx").cast("long").alias("key"), F.col("f.x").alias("x"))
    if prefetch:
        weights = weights.join(long.select("key").union(samples.sparkSession.range(1).select(F.col("id").alias("key"))).distinct(), "key", "left_semi")
    hit = long.distinct().join(weights, "key", "left").select("sample_id", F.struct("key", "x", F.coalesce("val", F.lit(0.0)).alias("val")).alias("e"))
    out = samples.drop("features").join(hit.groupBy("sample_id").agg(F.array_sort(F.collect_list("e")).alias("w")), "sample_id")  # as many as a sample has features
    if not bias:
        return out
    zero = weights.filter("key = 0").agg(F.coalesce(F.max("val"), F.lit(0.0)).alias("w0"))
    return out.join(F.broadcast(zero))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + f(e))


def lr_score(attached: DataFrame) -> DataFrame:
    """adds score = w0 + sum(val * x) and p, its logistic."""
    a = attached.withColumn("score", F.col("w0") + _sum(F.col("w"), lambda e: e["val"] * e["x"]))
    return a.withColumn("p", 1 / (1 + F.exp(-F.col("score"))))


def lr_push(attached: DataFrame, alpha: float, compat: bool = True) -> DataFrame:
    """(key, val, b, worker).

    compat: one scalar g = w0 + sum(x * error) is added, times alpha, to the
    bias and every weight of the sample; else each weight gets alpha * error * x
    and the bias alpha * error.
    """
    err = F.when(F.col("y") > 0, 1.0).otherwise(0.0) - F.col("p")
    s = lr_score(attached).withColumn("err", err)
    if compat:
        s = s.withColumn("g", F.col("w0") + _sum(F.col("w"), lambda e: e["x"] * F.col("err")))
        entry = lambda e: F.struct(e["key"].alias("key"), (e["val"] + alpha * F.col("g")).alias("val"))
        first = F.col("w0") + alpha * F.col("g")
    else:
        entry = lambda e: F.struct(e["key"].alias("key"), (e["val"] + alpha * F.col("err") * e["x"]).alias("val"))
        first = F.col("w0") + alpha * F.col("err")
    bias = F.array(F.struct(F.lit(0).cast("long").alias("key"), first.alias("val")))
    return s.select("b", "worker", F.explode(F.concat(bias, F.transform("w", entry))).alias("e")).select("e.key", "e.val", "b", "worker")


def lr_step(samples: DataFrame, weights: DataFrame, alpha: float = 1e-4, compat: bool = True, rows: int | None = None, prefetch: bool = False) -> DataFrame:
    return upsert(weights, lr_push(attach(samples, weights, rows, prefetch=prefetch), alpha, compat), ["b", "worker"])


def lr_predict(samples: DataFrame, weights: DataFrame, compat: bool = False, rows: int | None = None) -> DataFrame:
    """(sample_id, y, p, correct). compat: key 0 isn't read; the first feature's weight stands for the bias and its product is left out."""
    a = attach(samples, weights, rows)
    if compat:
        rest = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
        score = F.element_at("w", 1)["val"] + _sum(rest, lambda e: e["val"] * e["x"])
        a = a.withColumn("p", 1 / (1 + F.exp(-score)))
    else:
        a = lr_score(a)
    return a.select("sample_id", "y", "p", ((F.col("p") > 0.5) == (F.col("y") > 0)).cast("int").alias("correct"))


def svm_score(attached: DataFrame) -> DataFrame:
    """adds score = sum(val * x) over all but the first feature."""
    return attached.withColumn("rest", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).withColumn("score", _sum(F.col("rest"), lambda e: e["val"] * e["x"]))


def svm_push(attached: DataFrame, rate: float, lam: float) -> DataFrame:
    """(key, val, b, worker): shrinkage beyond the margin (y * score > 1), shrinkage and y * x within; the first feature's value is pushed as it is."""
    s = svm_score(attached)
    beyond = F.col("y") * F.col("score") > 1
    new = lambda e: F.when(beyond, e["val"] - rate * lam * e["val"]).otherwise(e["val"] - rate * (lam * e["val"] - F.col("y") * e["x"]))
    pushed = F.concat(F.transform(F.slice("w", 1, 1), lambda e: F.struct(e["key"].alias("key"), e["val"].alias("val"))), F.transform("rest", lambda e: F.struct(e["key"].alias("key"), new(e).alias("val"))))
    return s.select("b", "worker", F.explode(pushed).alias("e")).select("e.key", "e.val", "b", "worker")


def svm_step(samples: DataFrame, weights: DataFrame, rate: float = 2.0, lam: float = 1e-4, rows: int | None = None) -> DataFrame:
    return upsert(weights, svm_push(attach(samples, weights, rows, bias=False), rate, lam), ["b", "worker"])


def svm_predict(samples: DataFrame, weights: DataFrame, rows: int | None = None) -> DataFrame:
    s = svm_score(attach(samples, weights, rows, bias=False))
    sign = F.when(F.col("score") >= 0, 1).otherwise(-1)
    return s.select("sample_id", "y", "score", sign.alias("predicted"), (sign == F.col("y")).cast("int").alias("correct"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """(n, n_correct, accuracy in percent)."""
    return predicted.agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"), (100.0 * F.avg("correct")).alias("accuracy"))


# --- matrix factorization ------------------------------------------------------


def factor_keys(row: Column, n_rows: int, rank: int) -> Column:
    """Keys of a row's factors in one flattened table."""
    return F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda l: row + l * n_rows)


def rating_matrix(ratings: DataFrame) -> DataFrame:
    """(user, item, rating): the last rating by pos of each cell."""
    return ratings.groupBy("user", "item").agg(F.max_by("rating", "pos").alias("rating"))


def mean_rating(ratings: DataFrame, first: int = 5000) -> DataFrame:
    """(mean_rating): the sum of the first ratings by pos, divided by the number of all, cut off."""
    n = ratings.agg(F.count("*").alias("n"))
    head = ratings.select("pos", "rating").orderBy("pos").limit(first).agg(F.sum("rating").alias("s"))
    return head.join(n).select(F.expr("coalesce(s, 0) div n").cast("long").alias("mean_rating"))


def attach_factors(ratings: DataFrame, users: DataFrame, items: DataFrame, rank: int, zero: float) -> DataFrame:
    """ratings with bu, bi (0 where absent) and u, v; a zero factor reads as `zero`. users, items: (id, bias, f)."""
    fill = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda _: F.lit(0.0))
    seen = lambda f: F.transform(f, lambda x: F.when(x == 0, F.lit(zero)).otherwise(x))
    u = users.select(F.col("id").alias("user"), F.col("bias").alias("bu"), F.col("f").alias("u"))
    v = items.select(F.col("id").alias("item"), F.col("bias").alias("bi"), F.col("f").alias("v"))
    r = ratings.join(u, "user", "left").join(v, "item", "left")
    return r.withColumns({"bu": F.coalesce("bu", F.lit(0.0)), "bi": F.coalesce("bi", F.lit(0.0)), "u": seen(F.coalesce("u", fill)), "v": seen(F.coalesce("v", fill))})


def mf_predict(attached: DataFrame, mean: Column | float) -> DataFrame:
    """adds predicted and err."""
    mean = F.lit(float(mean)) if not isinstance(mean, Column) else mean
    inner = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    a = attached.withColumn("predicted", mean + F.col("bu") + F.col("bi") + inner)
    return a.withColumn("err", F.col("rating") - F.col("predicted"))


def mf_step(ratings: DataFrame, users: DataFrame, items: DataFrame, mean: float | Column, rank: int = 10, alpha: float = 1e-4, beta: float = 0.02, zero: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(users, items) after a superstep: each row's last rating by pos decides; the item's update uses the user's new factors.

    Every rating is joined once; what it pushes to its user and its item is one
    written table, of which each row's last push is kept.
    """
    p = mf_predict(attach_factors(ratings, users, items, rank, zero), mean)
    new_u = F.zip_with("u", "v", lambda a, b: a + alpha * (F.col("err") * b - beta * a))
    p = p.withColumn("nu", new_u)
    p = p.withColumn("nv", F.zip_with("v", "nu", lambda b, a: b + alpha * (F.col("err") * a - beta * b)))
    bias = lambda b: F.col(b) + alpha * (F.col("err") - beta * F.col(b))
    push = lambda side, id_, b, f: F.struct(F.lit(side).alias("side"), F.col(id_).cast("long").alias("id"), bias(b).alias("bias"), F.col(f).alias("f"))
    pushed = p.select("pos", F.explode(F.array(push("user", "user", "bu", "nu"), push("item", "item", "bi", "nv"))).alias("e")).select("pos", "e.*")
    pushed = saved(pushed.groupBy("side", "id").agg(F.max_by(F.struct("bias", "f"), "pos").alias("n")), "mf")

    def merged(old: DataFrame, side: str) -> DataFrame:
        new = pushed.filter(F.col("side") == side).drop("side")
        return old.join(new, "id", "full").select("id", F.coalesce("n.bias", "bias").alias("bias"), F.coalesce("n.f", "f").alias("f"))

    return merged(users, "user"), merged(items, "item")


def mf_error(ratings: DataFrame, users: DataFrame, items: DataFrame, mean: DataFrame, rank: int = 10, first: int = 5000) -> DataFrame:
    """(mean_rating, sse_root, rmse) over the cells of the first ratings by pos; zero factors stay zero here."""
    cells = rating_matrix(ratings.orderBy("pos").limit(first))
    p = mf_predict(attach_factors(cells.join(F.broadcast(mean)), users, items, rank, 0.0), F.col("mean_rating"))
    return p.groupBy("mean_rating").agg(F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("sse_root"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))


def factors_long(side: str, table: DataFrame) -> DataFrame:
    """(side, id, l, val): bias as l = -1."""
    e = F.concat(F.array(F.col("bias")), F.col("f"))
    return table.select(F.lit(side).alias("side"), "id", F.posexplode(e).alias("l", "val")).withColumn("l", F.col("l") - 1)


# --- batches -----------------------------------------------------------------------


def hold_out_last(samples: DataFrame, n: int, order: str, exclude: bool = True, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, test): the test set is the last n by order, of each `by` if given; it is trained on as well unless excluded."""
    if by:
        test = first_rows(samples, n, [by], [F.col(order).desc()], [order]).drop("_rank")
    else:
        test = samples.orderBy(F.col(order).desc()).limit(n)
    train = samples.join(test.select(F.col(order).alias("_o")), F.col(order) == F.col("_o"), "left_anti") if exclude else samples
    return train, test


def batch(samples: DataFrame, size: int | DataFrame, by: str, order: str, place: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """samples with b: position b of each worker's batch takes its sample b mod n; batches larger than n come round again.

    size is a number or a table (by, size); samples are in order of place, then
    order; counts (by, _n) saves counting them anew.
    """
    place = F.col(order) if place is None else place
    s = samples.withColumn("_place", place).drop("b")
    counts = samples.groupBy(by).agg(F.count("*").alias("_n")) if counts is None else counts
    most = size if isinstance(size, int) else size.agg(F.max("size")).first()[0]
    s = first_rows(s, most, [by], [F.col("_place"), F.col(order)], [order]).join(counts, by)
    s = s.withColumn("_size", F.lit(size)) if isinstance(size, int) else s.join(size.select(by, F.col("size").alias("_size")), by)
    positions = F.sequence(F.col("_rank"), F.col("_size") - 1, F.col("_n").cast("int"))
    return s.filter(F.col("_rank") < F.col("_size")).withColumn("b", F.explode(positions)).drop("_place", "_rank", "_n", "_size")


def shuffled(order: str, seed: int, iteration: int) -> Column:
    """A pseudo-random place that depends on seed, iteration and id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:{iteration}:"), F.col(order).cast("string")).cast("binary"))
