"""Deduplicating, ordering, splitting and planning over program rows.

Order is always an explicit column (seq): the smallest value is the first row. All operators are DataFrame to DataFrame.
Windows run over groups that a key bounds (a repository's share of a quota, a stratum); where only one row of a group
counts, an aggregate with map-side combining takes the window's place, so a hot group costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrysift.operators import prefix
from quarrysift.scratch import Scratch


def key_of(*columns: str) -> Column:
    """Fields as one text key, nulls as empty. Not one to one: a § inside a field parts it too, and null equals empty."""
    return F.concat_ws("§", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _tie(df: DataFrame) -> Column:
    """A hash of a row, to order rows that are otherwise equal; of columns that can be hashed."""
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(c) for c in plain])


def dedup_rows(df: DataFrame, keys: list[str], seq: str, prefer: str = "first", field: str | None = None, joined: bool = False) -> DataFrame:
    """One row for each key, with first_seq, the place of its first row: the first, the last, or that with the longest field.

    Of equally long ones the first stays; a row without seq counts as the last one for `first` and `longer`, as the first for
    `last`; rows of equal seq are told apart by a hash, so one row stays whatever repeats. Without keys all rows stay. Keys
    are compared column by column, null being a value of its own; with joined, as the text key_of. One aggregate with
    map-side combining: a task sends one row for a key, so no task meets all rows of one.
    """
    if not keys:
        return df.withColumn("first_seq", F.col(seq))
    row, place, tie = F.struct("*"), F.col(seq), _tie(df)
    if prefer == "last":
        best = F.max_by(row, F.struct(place.isNotNull(), place, tie))
    else:
        length = F.length(F.coalesce(F.col(field).cast("string"), F.lit(""))) if prefer == "longer" and field else F.lit(0)
        best = F.min_by(row, F.struct(-length, place.isNull(), place, tie))
    by = [key_of(*keys).alias("__k0")] if joined else [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*by).agg(best.alias("__row"), F.min(seq).alias("__first")).select("__row.*", F.col("__first").alias("first_seq"))


def dedup_exact(df: DataFrame, hashed: Column, seq: str) -> DataFrame:
    """The first row of each hash, with the hash."""
    return dedup_rows(df.withColumn("content_hash", hashed), ["content_hash"], seq).drop("first_seq")


def anti_duplicate(df: DataFrame, index: DataFrame, hashed: Column) -> DataFrame:
    """Rows whose hash the index does not have."""
    return df.withColumn("content_hash", hashed).join(index.select("content_hash").distinct(), "content_hash", "left_anti")


def add_programs(index: DataFrame, df: DataFrame, hashed: Column, seq: str) -> DataFrame:
    """The index with the rows whose hash is new to it; of equal new rows the first."""
    new = anti_duplicate(dedup_exact(df, hashed, seq).drop("content_hash"), index, hashed)
    return index.unionByName(new.select(*index.columns))


#: Rows that a range of a global order holds, about.
RANGE_ROWS = 2_000_000


def with_index(df: DataFrame, seq: str, out: str = "index", ties: tuple[str, ...] = (), owner: Scratch | None = None) -> DataFrame:
    """A 1-based index in the order of seq, then ties, then a hash of the row. Nulls come first.

    Rows are range-sorted and written once, with their place in their range; a range's first number is the sum of the ranges
    before it. The number of ranges grows with the rows, and rows of one seq are parted by ties and hash, so no task meets
    more than about RANGE_ROWS of them. One shuffle; only one count for each range is broadcast.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1)
    order = [seq, *ties, "__index_tie"]
    ranged = df.withColumn("__index_tie", _tie(df)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An id of this function is the partition's number, then the row's place in it.
    placed = Scratch(spark, owner).keep(ranged.drop("__index_tie").withColumn("__index_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__index_range", F.shiftright("__index_at", 33))
    counts = placed.groupBy("__index_range").agg(F.count(F.lit(1)).alias("__index_n"))
    before = counts.withColumn("__index_before", F.sum("__index_n").over(Window.orderBy("__index_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__index_n")).drop("__index_n")
    return placed.join(F.broadcast(before), "__index_range").withColumn(out, F.col("__index_before") + F.col("__index_at").bitwiseAND(2**33 - 1) + 1).drop("__index_range", "__index_at", "__index_before")


def per_group_top(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group, the first in order. Ranks above the limit are cut before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def random_order(seed: int, *ids: str) -> Column:
    """A key whose order is random but the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def shuffled_limit(df: DataFrame, seed: int, ids: list[str], most: int) -> DataFrame:
    return df.withColumn("shuffle_key", random_order(seed, *ids)).orderBy("shuffle_key", *ids).limit(most)


def stratified_split(df: DataFrame, strata: list[str], seed: int, ids: list[str], train: float = 0.6, test: float = 0.2, owner: Scratch | None = None) -> DataFrame:
    """A column split: in each stratum, in random order, the first int(n * train) rows, the next int(n * test), the rest.

    Places in a stratum are prefix sums over ranges of the random key, so a stratum with most of the rows is spread out.
    """
    rows = df.withColumns({"__stratum": F.concat_ws("§", *[F.coalesce(F.concat(F.lit("v"), F.col(s).cast("string")), F.lit("n")) for s in strata]), "__key": random_order(seed, *ids), "__one": F.lit(1).cast("long")})
    fine = Scratch(df.sparkSession, owner).keep(prefix.range_sums(rows, "__stratum", "__key", "__one"), "ranges")
    placed = prefix.sums_before(rows, fine, "__stratum", "__key", "__one", ids, "__before").join(prefix.group_sums(fine, "__stratum", "__n"), "__stratum")
    first, n = F.floor(F.col("__n") * F.lit(train)), F.col("__n")
    split = F.when(F.col("__before") < first, "train").when(F.col("__before") < first + F.floor(n * F.lit(test)), "validation").otherwise("test")
    return placed.select(*df.columns, split.alias("split"))


def plan_batch(repos: DataFrame, counts: DataFrame, target: int, batch: int, most_repos: int = 10, past_target: bool = False) -> DataFrame:
    """The least collected repositories and how many programs each should give: repo, collected, per_repo, batch_size, status.

    repos: (repo, seq); counts: (repo, collected); a null repo is one like any other, a null seq comes last. Without anything
    left, no repositories, which is status target_reached. With past_target the repositories are listed then too: batch_size
    is what is left, 0 or less.
    """
    have = repos.join(counts.withColumnRenamed("repo", "__repo"), F.col("repo").eqNullSafe(F.col("__repo")), "left").select("repo", "seq", F.coalesce("collected", F.lit(0)).cast("long").alias("collected"))
    total = counts.agg(F.coalesce(F.sum("collected"), F.lit(0)).cast("long").alias("total"))
    least = have.orderBy("collected", F.asc_nulls_last("seq"), "repo").limit(most_repos)
    n = least.agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(batch).cast("long"), F.lit(target) - F.col("total"))
    sized = least.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).withColumn("batch_size", size)  # two rows of scalars
    planned = sized if past_target else sized.where("batch_size > 0")
    return planned.select("repo", "collected", "batch_size", F.greatest(F.lit(1).cast("long"), F.floor(F.col("batch_size") / F.col("n")).cast("long")).alias("per_repo"), F.lit("planned").alias("status"))


def positional_join(left: DataFrame, right: DataFrame, left_seq: str, right_seq: str) -> DataFrame:
    """The k-th row of one side with the k-th of the other; rows without a partner go."""
    return with_index(left, left_seq, "position").join(with_index(right, right_seq, "position"), "position")


def semi_or_all(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the keys; all rows if there are none."""
    flagged = keys.select(on).distinct()
    some = flagged.agg((F.count(F.lit(1)) > 0).alias("__some"))
    marked = df.join(flagged.withColumn("__hit", F.lit(True)), on, "left").crossJoin(F.broadcast(some))
    return marked.where(F.coalesce(F.col("__hit"), F.lit(False)) | ~F.col("__some")).drop("__hit", "__some")


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[_\-.]+"), lambda t: t != ""))


def best_match(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each name the candidate with most tokens in common, the first of equal ones: (name, candidate, shared).

    Names and candidates meet by token, not each with each; a name that shares no token gets the first candidate, as it
    would with no token in common with any.
    """
    left = names.select("name", F.explode(name_tokens(F.col("name"))).alias("token"))
    right = candidates.select("candidate", "seq", F.explode(name_tokens(F.col("candidate"))).alias("token"))
    shared = left.join(right, "token").groupBy("name", "candidate", "seq").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("name").agg(F.max_by(F.struct("candidate", "shared"), F.struct(F.col("shared"), -F.col("seq"))).alias("b"))
    first = candidates.agg(F.min_by("candidate", "seq").alias("first"))
    joined = names.select("name").distinct().join(best, "name", "left").crossJoin(F.broadcast(first))
    return joined.select("name", F.coalesce("b.candidate", "first").alias("candidate"), F.coalesce("b.shared", F.lit(0)).cast("long").alias("shared"))


def diverse(df: DataFrame, repo: str, folder: str, seq: str, free: int = 10, folders: int = 5) -> DataFrame:
    """Per repository in order: once `free` rows are taken from `folders` folders or more, rows of folders seen before go.

    Until then every row is taken, and afterwards only the first row of a folder. So what stays is: rows up to the later one
    of the free-th row and the folders-th new folder of the repository (all, where it has fewer), and each folder's first
    row. seq is unique within a repository. The rows themselves meet one row for their (repository, folder).
    """
    light = df.select(F.col(repo).alias("__r"), F.col(folder).alias("__f"), F.col(seq).alias("__s"))

    def nth(rows: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("__r").orderBy("__s"))
        return rows.select("__r", "__s").withColumn("__n", place).where(F.col("__n") <= n).where(F.col("__n") == n).drop("__n")

    firsts = light.groupBy("__r", "__f").agg(F.min("__s").alias("__s"))
    until = nth(light, free).unionByName(nth(firsts, folders)).groupBy("__r").agg(F.max("__s").alias("__until"), F.count(F.lit(1)).alias("__both")).where("__both = 2")
    bounds = firsts.withColumnRenamed("__s", "__first").join(until, firsts["__r"].eqNullSafe(until["__r"]), "left").select(firsts["__r"], "__f", "__first", "__until")
    met = df.join(bounds, df[repo].eqNullSafe(bounds["__r"]) & df[folder].eqNullSafe(bounds["__f"]))
    return met.where(F.col("__until").isNull() | (F.col(seq) <= F.col("__until")) | (F.col(seq) == F.col("__first"))).select(*[df[c] for c in df.columns])
