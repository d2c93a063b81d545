"""Deterministic stratified folds, samples, hold-outs and class weights.

Order inside a class is the md5 of the key and a seed. Positions come from
`hash_rank`, so a class holding most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import order_key, r6
from foldwise.operators.lookup import attach, keep, sized
from foldwise.operators.ranks import hash_rank, radix_digits


def stratified_folds(df: DataFrame, key: Sequence[str | Column], label: str, k: int = 5, seed: int = 42,
                     out: str = "fold", digits: int | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """Add a fold column; sizes differ by at most one per class. With `carry` only these columns and the label stay, and the rows are kept, for jobs that read them
    several times."""
    t = df.withColumn("_h", order_key(key, seed))
    t = t if carry is None else t.select("_h", label, *[c for c in dict.fromkeys(carry) if c != label])
    t = hash_rank(t, "_h", [label], digits, "_r", once=carry is not None)
    return t.withColumn(out, (F.col("_r") % k).cast("int")).drop("_h", "_r", "_r_total")


def seeded_folds(df: DataFrame, key: Sequence[str | Column], label: str, k: int, seeds: Sequence[int], carry: Sequence[str], twin: str, width: int) -> DataFrame:
    """(label, carry, fold_<seed> for each seed, twin): the folds of `stratified_folds` for several seeds side by side, without a join of the rows by key.

    Bucket totals of all seeds are counted in one pass over the source. The rows then go from the order of one seed to that of the next, with the first `width`
    bytes of each md5 still needed, and none of them are kept. `twin` is the last of these for rows of a class that share them for any seed, else missing.
    """
    hashes = [f"_h{i}" for i in range(len(seeds))]
    digits = radix_digits(df, [label])
    t = df.select(label, *carry, F.lit(False).alias("_same"), *[order_key(key, s).alias(h) for h, s in zip(hashes, seeds)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.substring(h, 1, digits).alias("b")) for i, h in enumerate(hashes)]))
    counts = t.select(label, each.alias("e")).groupBy(F.col(label).alias("_k"), F.col("e.s").alias("_s"), F.col("e.b").alias("_k_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k", "_s").orderBy("_k_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(counts.select("_k", "_s", "_k_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))  # one row a bucket
    t = t.withColumns({h: F.substring(F.unhex(h), 1, width) for h in hashes})
    for i, (h, s) in enumerate(zip(hashes, seeds)):
        t = t.withColumn("_b", F.substring(F.lower(F.hex(h)), 1, digits))
        order = Window.partitionBy(label, "_b").orderBy(h)
        next_to = lambda other: F.coalesce(other.over(order) == F.col(h), F.lit(False))
        t = t.withColumns({"_in": F.row_number().over(order) - 1, "_same": F.col("_same") | next_to(F.lag(h)) | next_to(F.lead(h))})
        t = t.withColumn(twin, F.when(F.col("_same"), F.col(h)))
        off = sized(offsets.where(F.col("_s") == i).drop("_s"))
        t = t.join(off, F.col(label).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_k_b")))
        t = t.withColumn(f"fold_{s}", ((F.col("_in") + F.col("_off")) % k).cast("int")).drop(h, "_b", "_in", "_k", "_k_b", "_off", *([twin] if h != hashes[-1] else []))
    return t.drop("_same")


def seed_counts(df: DataFrame, key: Sequence[str | Column], label: str, k: int, seeds: Sequence[int], by: Sequence[str], twin: str = "twin") -> DataFrame:
    """(label, by, fold_<seed> for each seed, twin, n): rows counted by what is read of them; `twin` tells the rows of a class that share their key.

    Eight bytes of an md5 order the rows unless two of them have the same, by chance or as they share a key; then all are taken, so the folds are exact.
    """
    for width in (8, 16):
        t = seeded_folds(df, key, label, k, seeds, by, twin, width)
        cells = keep(t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n")))
        if width == 16 or cells.where(F.col(twin).isNotNull()).isEmpty():
            return cells
        cells.unpersist()


def train_side(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != k)


def valid_side(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == k)


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows to train on and rows to validate on, per fold."""
    c = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_val"))
    whole = F.sum("n_val").over(Window.partitionBy(F.lit(0)))
    return c.select(fold, (whole - F.col("n_val")).alias("n_train"), "n_val")


def fold_contract(df: DataFrame, key: Sequence[str], label: str, fold: str = "fold", tolerance: float = 0.005) -> DataFrame:
    """Class share per fold against the overall share, with the balance verdict and the id checks.

    `repeated_ids` counts ids seen more than once or in two folds, `unassigned` counts missing folds.
    """
    ids = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("r"))
    c = df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(fold))
    overall = F.sum("n").over(Window.partitionBy(label)) / F.sum("n").over(all_rows)
    lost = F.coalesce(F.sum(F.when(F.col(fold).isNull(), F.col("n"))).over(all_rows), F.lit(0))
    t = c.select(fold, label, "n", share.alias("share"), overall.alias("overall"), lost.alias("unassigned"))
    return t.select(fold, label, "n", r6(F.col("share")).alias("share"), r6(F.col("share") - F.col("overall")).alias("delta"),
                    (F.abs(F.col("share") - F.col("overall")) <= tolerance).alias("balanced"), "unassigned",
                    ids.scalar().alias("repeated_ids"))


def require_folds(df: DataFrame, key: Sequence[str], label: str, fold: str = "fold", k: int | None = None) -> DataFrame:
    wrong = ~F.col("balanced") | (F.col("unassigned") > 0) | (F.col("repeated_ids") > 0)
    rows = fold_contract(df, key, label, fold).groupBy(fold).agg(
        F.count_if(wrong).alias("wrong_labels"), F.max(F.abs("delta")).alias("largest_delta"), F.max("unassigned").alias("unassigned"),
        F.max("repeated_ids").alias("repeated_ids")).orderBy(fold).collect()
    bad = [r for r in rows if r["wrong_labels"]]
    if bad or (k is not None and len(rows) != k):
        raise ValueError(f"fold contract failed, {len(rows)} folds: {[r.asDict() for r in bad]}")
    return df


def stratified_sample(df: DataFrame, key: Sequence[str | Column], label: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * class size) rows per class."""
    return hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [label], out="_r",
                     limit=F.bround(F.col("_r_total") * F.lit(fraction))).drop("_h", "_r", "_r_total")


def seeded_sample(df: DataFrame, key: Sequence[str | Column], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, chosen by md5 position."""
    return hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [], out="_r", limit=F.lit(n)).drop("_h", "_r", "_r_total")


def shuffle_position(df: DataFrame, key: Sequence[str | Column], seed: int = 42, out: str = "position") -> DataFrame:
    """Deterministic shuffle as a zero-based position column."""
    t = hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [], out="_r")
    return t.withColumn(out, F.col("_r")).drop("_h", "_r", "_r_total")


def holdout_split(df: DataFrame, key: Sequence[str | Column], parts: int = 20, seed: int = 42, out: str = "split") -> DataFrame:
    """Hold out one part in `parts`, at least one row."""
    t = hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [], out="_r")
    cut = F.greatest(F.lit(1), F.floor(F.col("_r_total") / parts))
    return t.withColumn(out, F.when(F.col("_r") < cut, "valid").otherwise("train")).drop("_h", "_r", "_r_total")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class; mean one over the rows. Empty in, empty out."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    w = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return c.select(label, "n", w.alias("weight"))


def fold_class_weights(df: DataFrame, label: str, k: int, fold: str = "fold") -> DataFrame:
    """Balanced weights computed on the training side of every fold, from one (fold, class) count table."""
    c = df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, carrying a map with at most k entries.
    per = c.groupBy(label).agg(F.sum("n").alias("n_label"), F.map_from_entries(F.collect_list(F.struct(fold, "n"))).alias("m"))
    grid = per.select(label, "n_label", "m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
    held = F.coalesce(F.try_element_at("m", F.col(fold)), F.lit(0))
    train = grid.select(fold, label, (F.col("n_label") - held).alias("n_train")).where("n_train > 0")
    w = Window.partitionBy(fold)
    return train.select(fold, label, "n_train",
                        r6(F.sum("n_train").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_train"))).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    return attach(df, weights.select(label, "weight"), [label])


def oversample(df: DataFrame, label: str, factors: dict[str, int]) -> DataFrame:
    """Repeat rows of the listed classes; `copy` numbers the repeats from one."""
    f = F.lit(1)
    for value, times in factors.items():
        f = F.when(F.col(label) == value, F.lit(int(times))).otherwise(f)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), f)))


def pseudo_label(train: DataFrame, scored: DataFrame, label: str, confidence: Column, predicted: Column,
                 threshold: float, weight: float = 0.5) -> DataFrame:
    """Append confidently scored rows with their predicted label, a lower weight and a source flag."""
    extra = scored.where(confidence >= threshold).withColumn(label, predicted)
    cols = [c for c in train.columns if c in extra.columns]
    return (train.select(*cols, F.lit("train").alias("source"), F.lit(1.0).alias("weight"))
            .unionByName(extra.select(*cols, F.lit("pseudo").alias("source"), F.lit(weight).alias("weight"))))


def augment(base: DataFrame, extra: DataFrame, weight: float = 1.0) -> DataFrame:
    """Stack original and additional rows with a source column and a weight."""
    return (base.withColumns({"source": F.lit("base"), "weight": F.lit(1.0)})
            .unionByName(extra.withColumns({"source": F.lit("extra"), "weight": F.lit(float(weight))}), allowMissingColumns=True))
