"""Joins, windows and keyed selections that keep their plans free of needless shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut_lineage

#: Entries of a list searched at once; longer lists are searched in blocks.
LIST_BLOCK = 100_000


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, or an error naming the columns it lacks."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` whose key `right` lacks; null keys are missing."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def align_strict(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows of `df` in the ids of `reference`; an error if the two sets of ids differ."""
    a, b = df.select(key).distinct(), reference.select(key).distinct()
    odd = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer").filter("_a is null or _b is null").limit(3).collect()
    if odd:
        raise ValueError(f"ids differ, among others {[r[0] for r in odd]}")
    return df.join(b, key, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def best_per_key(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """The columns of the row with the largest `order` of each key; null keys form one group."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("_r")).select(*keys, "_r.*")


def dense_ids(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """local_id 0, 1, 2, ... over the sorted keys, without a global window: ranks come from partition offsets."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(df.repartitionByRange(n, key).sortWithinPartitions(key))
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offset = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_p int, _start bigint"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumns({"_p": F.spark_partition_id(), "_row": row}).join(offset, "_p").withColumn("local_id", F.col("_row") + F.col("_start")).drop("_p", "_row", "_start")


def _contained(entries: list[tuple]):
    """Search of a block of entries (order, needle, other), sorted by order: the first one whose needle a text holds or whose other holds the text."""
    import bisect

    import ahocorasick
    import pyarrow as pa

    automaton = ahocorasick.Automaton()
    for i, (_, needle, _) in enumerate(entries):
        if needle and needle not in automaton:
            automaton.add_word(needle, i)
    if len(automaton):
        automaton.make_automaton()
    starts, at = [], 0
    for *_, other in entries:
        starts.append(at)
        at += len(other or "") + 1
    glued = "\0".join(other or "" for *_, other in entries)

    def first(text: str) -> int | None:
        hits = [i for _, i in automaton.iter(text)] if len(automaton) else []
        if text and "\0" not in text and (p := glued.find(text)) >= 0:
            hits.append(bisect.bisect_right(starts, p) - 1)
        return min(hits, default=None)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found = [None if t is None else first(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if i is None else entries[i][0] for i in found], pa.string())], ["_id", "_entry"])

    return run


def first_containment(df: DataFrame, vocab: DataFrame, key: str, text: str, needle: str, other: str, order: str, block: int = LIST_BLOCK) -> DataFrame:
    """Each row with the first entry, in list order, whose `needle` its text holds or whose `other` holds it.

    A block of the list is an automaton over the needles and one string of the
    others, built once a task; each text is read once, nothing is compared
    pair by pair. A list above `block` entries is searched in blocks, the
    first hit of all counts. Empty needles and null texts match nothing.
    """
    rows = sorted((str(r[0]), r[1], r[2]) for r in vocab.select(order, needle, other).filter(F.col(order).isNotNull()).collect())
    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    best = None
    for a in range(0, max(1, len(rows)), block):
        hit = own.mapInArrow(_contained(rows[a : a + block]), f"_id {kind}, _entry string").filter("_entry is not null")
        best = hit if best is None else best.unionByName(hit)
    if len(rows) > block:
        best = best.groupBy("_id").agg(F.min("_entry").alias("_entry"))
    return best.join(F.broadcast(vocab.limit(block)) if len(rows) <= block else vocab, F.col("_entry") == F.col(order).cast("string")).withColumnRenamed("_id", key).drop("_entry")


def running(df: DataFrame, keys: list[str], order: list[Column], **values: Column) -> DataFrame:
    """The frame with running sums of `values` within each key in a total order, this row included.

    Rows are range-partitioned by key and order; sums run within a partition
    and start from the sums of the partitions before it, so a key with a
    third of all rows spreads over a third of the tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumns({**{f"_o{i}": c for i, c in enumerate(order)}, **{f"_v_{k}": v for k, v in values.items()}})
    by = [*keys, *(f"_o{i}" for i in range(len(order)))]
    placed = cut_lineage(x.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_p", *keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values], F.lit(1).alias("_one"))
    carried = sums.withColumns({**{f"_b_{k}": F.sum(f"_s_{k}").over(before) for k in values}, "_earlier": F.count("_one").over(before)}).filter("_earlier > 0")
    # keys that run over a partition's end: fewer rows than partitions
    starts = F.broadcast(carried.select(F.col("_p").alias("_sp"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_b_{k}" for k in values]))
    local = placed.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(w) for k in values})
    joined = local.join(starts, (local["_p"] == F.col("_sp")) & _all_same(local, keys), "left")
    return joined.select(*df.columns, *[(F.col(f"_r_{k}") + F.coalesce(f"_b_{k}", F.lit(0))).alias(k) for k in values])


def sliced(df: DataFrame, keys: list[str], order: list[Column], back: int = 0, ahead: int = 0, size: int = 1_000_000) -> DataFrame:
    """The frame in slices of `size` rows of a key for windows that look at most `back` rows back and `ahead` rows ahead.

    Adds _n (the row's place in its key, from 1), _slice and _own; each slice
    has the rows of its neighbours that it looks at, for which _own is false.
    Windows by (keys, _slice) over _n then see what they would see in the
    whole key, and a hot key is many tasks.
    """
    x = running(df, keys, order, _n=F.lit(1)).withColumns({"_slice": F.floor((F.col("_n") - 1) / size), "_own": F.lit(True)})
    place = (F.col("_n") - 1) % size
    copied = lambda which, step: x.filter(which).withColumns({"_slice": F.col("_slice") + step, "_own": F.lit(False)})
    out = x.unionByName(copied(place >= size - back, 1)) if back else x
    return out.unionByName(copied(place < ahead, -1)) if ahead else out


def _all_same(df: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & df[k].eqNullSafe(F.col(f"_k{i}"))
    return out


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points within ranges, both ends included, as an equi-join on buckets of `width`; a range appears once in each bucket it touches."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.filter(F.col(lo).isNotNull() & (F.col(hi) >= F.col(lo))).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "_b").filter(F.col(point).between(F.col(lo), F.col(hi))).drop("_b")


def reconcile_orphans(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, parent, state): root, child, or orphan where the parent is no row."""
    up = df.select(F.col(key).alias("_p")).distinct()
    state = F.when(F.col("_p").isNull() & F.col(parent).isNotNull(), "orphan").when(F.col(parent).isNull(), "root").otherwise("child")
    return df.join(up, F.col(parent) == F.col("_p"), "left").select(key, parent, state.alias("state"))


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[str], distinct: bool = True) -> DataFrame:
    """Rows of `new` whose key `old` lacks; of repeats inside `new` the first stays, unless distinct is False."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    if not distinct:
        return fresh.select(*new.columns)
    rest = [c for c in new.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*new.columns)


def unique_or_mixed(c: str) -> Column:
    """The only value of a group, '' without one, 'mixed' with several; min and max suffice, no distinct shuffle."""
    return F.when(F.max(c).isNull(), "").when(F.min(c) == F.max(c), F.max(c)).otherwise("mixed")


def next_child_ids(ontology: DataFrame, arrivals: DataFrame, order: str) -> DataFrame:
    """(parent_id, order, child_id): ids after each parent's largest child, by arrival.

    A parent is any entry of the ontology; without children it starts at 1.
    Numbers run over range partitions, so a parent with many arrivals is no single task.
    Numbers have three digits at least and are kept whole beyond 999.
    """
    top = ontology.filter(F.col("ontology_id").rlike(r"\.\d+$")).groupBy("parent_id").agg(F.max(F.regexp_extract("ontology_id", r"\.(\d+)$", 1).cast("bigint")).alias("mx"))
    parents = ontology.select(F.col("ontology_id").alias("parent_id")).distinct().join(top, "parent_id", "left")
    x = running(arrivals.join(parents, "parent_id"), ["parent_id"], [F.col(order)], _n=F.lit(1))
    n = (F.coalesce("mx", F.lit(0)) + F.col("_n")).cast("string")
    return x.select("parent_id", order, F.concat("parent_id", F.lit("."), F.when(F.length(n) > 3, n).otherwise(F.lpad(n, 3, "0"))).alias("child_id"))


def within_budget(df: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """Rows in order until their running size exceeds the budget (W11). For bounded lists such as the blocks of one context."""
    run = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).filter(F.col("_run") <= budget).drop("_run")


def split_ids(ids: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """(key, part): ids ranked by a seeded hash and cut into shares (M03); ranks come from partition offsets, not from one task."""
    hashed = ids.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    ranked = dense_ids(hashed.withColumn("_o", F.struct("_h", key)), "_o")
    total = F.broadcast(ids.agg(F.count("*").alias("_t")))
    x = ranked.join(total).withColumn("_r", F.col("local_id") + 1)
    part, edge = None, 0.0
    for name, share in list(shares.items())[:-1]:
        edge = round(edge + share, 9)
        cond = F.col("_r") <= F.lit(edge) * F.col("_t")
        part = F.when(cond, name) if part is None else part.when(cond, name)
    return x.select(key, part.otherwise(list(shares)[-1]).alias("part"))


def lookup_in_array(df: DataFrame, key: str, ids: str, table: DataFrame, id_col: str, text: str, missing: str = "Sentence %s not found") -> DataFrame:
    """Rows (key, texts): each id of an array replaced by its text, in order; an unknown one by the `missing` text (J12). Null arrays stay null."""
    x = df.select(key, F.posexplode(ids).alias("_pos", "_id")).join(table.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_id", "left")
    shown = F.coalesce("_text", F.format_string(missing, F.col("_id").cast("string")))
    found = x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", shown.alias("t")))), lambda s: s["t"]).alias("texts"))
    empty = F.when(F.col(ids).isNotNull(), F.array().cast("array<string>"))
    return df.join(found, key, "left").select(*df.columns, F.coalesce("texts", empty).alias("texts"))


def select_features(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The key and the listed columns, or an error naming those the frame lacks."""
    return require_columns(df, key, *names).select(key, *names)


def concat_columns(frames: list[DataFrame], key: str) -> DataFrame:
    """Columns of several frames side by side by key; keys of any frame stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full_outer")
    return out
