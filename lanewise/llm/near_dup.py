"""MinHash near-dedup with b-bit signatures.

Texts become sets of hashed five-word shingles.  Equal sets form a class, of which the least doc_id stands for all.
Representatives share a bucket where the four minima of a band agree.  A pair of a bucket is a candidate if the
collision-corrected similarity of the packed signatures, estimated by bit counts, isn't clearly below the threshold;
it is linked if the full sets confirm it.  In small sets a few shingles fill all bins and the estimate says little:
they go along whole, and two of them are compared by their sets instead.

No bucket is expanded into all its pairs.  First each document is compared with one other: of the least members of its
buckets, the one that it meets most often.  Then large components that share a bucket are compared by one member each.
At last only buckets whose members still lie in different components are looked at again, and there only pairs across
components are compared, first those whose estimate reaches the threshold, then the doubtful ones; all other pairs are
connected already, and so can't change a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import free_prefix, quoted, tidy
from .storage import Scratch
from .textnum import Densifier, WordHasher, mix, one_permutation, text_chunks

#: 100 * intersection >= 75 * union.
THRESHOLD = 75
BIN_BITS = 10
LOW_BITS = 2
ROWS = 4
#: A pair at the threshold misses all of 40 bands of 4 with a chance of (1 - 0.75**4)**40 = 2.5e-7.
BANDS = 40
#: Five standard deviations of an estimate from 1024 bins of two bits at the threshold.
SLACK = 0.082
#: Shingles up to which a set goes along with its signature.  Beyond it the bins are independent enough for SLACK.
FEW = 64
#: Members of one bucket that one task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Members up to which a bucket is compared along with others in one pass over a sorted partition.
SMALL = 64
#: Components from this size on are compared by one member for each bucket before all members are.
LARGE = 8
#: Bits of the filter that picks the texts whose sets are needed: so many for each id, 4 MB at most.  For more ids than
#: that gives room to, texts are joined by id instead.
FILTER_BITS, BITS_EACH = 1 << 25, 8
WORDS = LOW_BITS * (1 << BIN_BITS) // 64

SETS = "doc_id long, n_shingles long, set_a long, set_b long, signature array<long>, bands array<long>, few array<long>"


def pack(low: np.ndarray) -> np.ndarray:
    """Bins of LOW_BITS bits each as 64-bit words: first all bins' lowest bits, then the next."""
    planes = [np.packbits((low >> k) & 1, bitorder="little").view(np.int64) for k in range(LOW_BITS)]
    return np.concatenate(planes)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Size, two hashes of the set, signature and band keys of each row's shingle set, and the set if it is small; null text
    counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, densifier = WordHasher(), Densifier(BIN_BITS)
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            sizes, one, two, signatures, bands, few = [], [], [], [], [], []
            for _, _, data, starts in text_chunks(batch.column(1)):
                for hashes in hasher.shingles(data, starts):
                    u = np.unique(hashes)
                    sizes.append(len(u))
                    few.append(u.view(np.int64) if len(u) <= FEW else None)
                    one.append(u.sum(dtype=np.uint64))
                    two.append(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if not len(u):
                        signatures.append(None)
                        bands.append(None)
                        continue
                    minima = densifier.fill(*one_permutation(u, BIN_BITS))
                    signatures.append(pack(minima.astype(np.uint8) & np.uint8((1 << LOW_BITS) - 1)))
                    key, rows = salt.copy(), minima[: BANDS * ROWS].reshape(BANDS, ROWS)
                    for k in range(ROWS):
                        key = mix(key + rows[:, k])
                    bands.append(key.view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (one, two)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (signatures, bands, few)]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), *signed, *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands", "few"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), SETS)


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, hashes): the whole shingle set of each row, as distinct 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = []
            for _, _, data, starts in text_chunks(batch.column(1)):
                sets += [np.unique(h).view(np.int64) for h in hasher.shingles(data, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    return docs.mapInArrow(tidy(run), "id long, hashes array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures, corrected for bins that agree by chance."""
    half, n = WORDS // LOW_BITS, float(1 << BIN_BITS)
    differ = sum(
        F.bit_count(
            F.expr("0L")
            .bitwiseOR(a[k].bitwiseXOR(b[k]))
            .bitwiseOR(a[k + half].bitwiseXOR(b[k + half]))
        )
        for k in range(half)
    )
    chance = 2.0**-LOW_BITS
    return ((1 - differ / n) - chance) / (1 - chance)


def plausible(a: str, b: str) -> Column:
    """What a pair must meet before its full sets are read: sizes that allow the threshold, and the estimate, or for two
    small sets the threshold itself."""
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    common = F.size(F.array_intersect(f"{a}_few", f"{b}_few"))
    return (100 * F.least(x, y) >= THRESHOLD * F.greatest(x, y)) & F.when(
        (x <= FEW) & (y <= FEW), 100 * common >= THRESHOLD * (x + y - common)
    ).otherwise(estimate(F.col(f"{a}_sig"), F.col(f"{b}_sig")) >= THRESHOLD / 100 - SLACK)


def marked(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs with a column that is false for rows whose doc_id is surely not in ids.

    A bitmap of hashed ids is broadcast, and no text is shuffled; it is made as large as the number of ids needs.  True
    may be wrong; where it matters an exact join follows, which then moves few rows besides the wanted ones.  Too many
    ids for the largest bitmap are joined, so that all texts move once; then true is never wrong.
    """
    p, n = free_prefix(docs, "near_"), ids.count()
    if n * BITS_EACH > FILTER_BITS:
        wanted = ids.select(F.col("doc_id").alias(f"{p}id")).distinct()
        joined = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col(f"{p}id"), "left")
        return joined.withColumn(name, F.col(f"{p}id").isNotNull()).drop(f"{p}id")
    bits = 1 << max(16, (n * BITS_EACH).bit_length())
    spot, page, held = f"{p}spot", f"{p}page", f"{p}bits"
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias(spot)
    maps = (
        ids.where("doc_id is not null").select(hashed)
        .groupBy(F.expr(f"bitmap_bucket_number({spot})").alias(page))
        .agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({spot}))").alias(held))
    )
    near = docs.withColumn(spot, hashed).join(F.broadcast(maps), F.expr(f"bitmap_bucket_number({spot})") == F.col(page), "left")
    place = F.expr(f"bitmap_bit_position({spot})")
    byte = F.conv(F.hex(F.substring(held, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    return near.withColumn(name, found).drop(spot, page, held)


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the threshold.

    Sets are built once for the ids in pairs.  Both joins are plain sort-merge joins, which Spark splits where one id
    has very many partners; nothing is gathered by id.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct())
    # What passes the bitmap by chance meets no pair below.
    wanted = marked(docs, ids, "_held").where("_held").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = scratch.keep(full_sets(wanted), f"{label}-sets")
    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"{k}_set")) for k in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    inter = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - inter
    return scratch.keep(both.where(100 * inter >= THRESHOLD * union).select("a", "b").distinct(), label)


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """estimate() over rows of two arrays of signatures."""
    t, half, chance = x ^ y, WORDS // LOW_BITS, 2.0**-LOW_BITS
    differ = np.bitwise_count(t[:, :half] | t[:, half:]).sum(axis=1)
    return ((1 - differ / (1 << BIN_BITS)) - chance) / (1 - chance)


def _padded(sets: list, lengths: np.ndarray) -> np.ndarray:
    """The small sets as rows of FEW hashes, zeros behind them; rows of large sets are all zeros."""
    out = np.zeros((len(lengths), FEW), np.int64)
    out[np.arange(FEW) < np.where(lengths <= FEW, lengths, 0)[:, None]] = sets
    return out


def _near(i: np.ndarray, j: np.ndarray, size: np.ndarray, sig: np.ndarray, few: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs of rows i and j can be links: two small sets by the threshold, others by the estimate."""
    ok, small = np.zeros(len(i), bool), (size[i] <= FEW) & (size[j] <= FEW)
    large, small = np.flatnonzero(~small), np.flatnonzero(small)
    ok[large] = _estimates(sig[i[large]], sig[j[large]]) >= least
    for s in range(0, len(small), 1 << 14):
        at = small[s : s + (1 << 14)]
        m, n = size[i[at]], size[j[at]]
        x, y = few[i[at], : m.max()].T, few[j[at], : n.max()].T  # a hash of each pair in turn
        common = np.zeros(len(at), np.int64)
        for k in range(len(x)):
            common += (y == x[k]).any(axis=0) & (k < m)
        ok[at] = 100 * common >= THRESHOLD * (m + n - common)
    return ok


def _met_first(x: np.ndarray, y: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """Whether a bucket is the first that the rows of two arrays of band keys share: one bucket reports each pair."""
    if not len(x):
        return np.zeros(0, bool)
    first = x[np.arange(len(x)), (x == y).argmax(axis=1)]
    return first == (bucket >> 32)


def _sizes_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(x, y) >= THRESHOLD * np.maximum(x, y)


def _small_buckets(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (bucket, id, component, size, sig, keys, few), sorted by bucket, whose buckets have at most SMALL
    rows."""
    rest = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in _with_end(batches):
        new = [] if batch is None else [pa.Table.from_batches([batch])]
        table = pa.concat_tables(([] if rest is None else [rest]) + new) if new or rest is not None else None
        if table is None or not table.num_rows:
            continue
        bucket = table.column(0).to_numpy()
        end = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1], "left"))
        rest, table, bucket = table.slice(end), table.slice(0, end), bucket[:end]
        if not end:
            continue
        ids, comp, size = (table.column(k).to_numpy() for k in (1, 2, 3))
        sig, keys = (pc.list_flatten(table.column(k)).to_numpy().reshape(end, -1) for k in (4, 5))
        sig, few = sig.view(np.uint64), _padded(pc.list_flatten(table.column(6)).to_numpy(), size)
        for d in range(1, min(SMALL, end)):
            i = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(i):
                break
            i = i[(comp[i] != comp[i + d]) & _sizes_fit(size[i], size[i + d])]
            i = i[_near(i, i + d, size, sig, few, least)]
            i = i[_met_first(keys[i], keys[i + d], bucket[i])]
            pair = np.sort(np.stack([ids[i], ids[i + d]], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _large_bucket(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of one block of a bucket's members with one block of those outside its main component."""
    right = pdf["right"].to_numpy()
    ids, comp, size = (pdf[c].to_numpy() for c in ("id", "component", "size"))
    sig, keys = np.stack(pdf["sig"].to_numpy()).view(np.uint64), np.stack(pdf["keys"].to_numpy())
    few = _padded(np.concatenate([np.zeros(0, np.int64), *(x for x in pdf["few"] if x is not None)]), size)
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    found = []
    for k in range(0, len(left), 256):
        x = left[k : k + 256]
        i, j = np.nonzero(_sizes_fit(size[x][:, None], size[right][None, :]) & (comp[x][:, None] != comp[right][None, :]))
        for s in range(0, len(i), 1 << 17):
            p, q = x[i[s : s + (1 << 17)]], right[j[s : s + (1 << 17)]]
            ok = _near(p, q, size, sig, few, least)
            p, q = p[ok], q[ok]
            ok = _met_first(keys[p], keys[q], pdf["bucket"].iloc[0])
            found.append(np.sort(np.stack([ids[p[ok]], ids[q[ok]]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _across(members: DataFrame, signed: DataFrame, scratch: Scratch, label: str, parts: int, least: float) -> DataFrame:
    """Pairs(a, b) of different components whose estimate is `least` or more, or whose small sets reach the threshold, in
    each bucket of members(bucket, id, component); signed(id, size, sig, keys, few) has what they are compared by.

    In a large bucket the most frequent component is the main one.  Everything is compared with what lies outside it;
    both sides are dealt out in blocks, so a task holds two blocks however large the bucket is.  The buckets' shapes are
    written first: the join with them then is one of two plain shuffles, of which Spark splits the side with a hot bucket.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    shape = (
        counts.groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("components"))
        .where("components > 1")
        .select(
            "bucket",
            "n",
            F.col("top.component").alias("main"),
            F.ceil(F.col("n") / BLOCK).alias("lefts"),
            F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("rights"),
        )
    )
    placed = members.join(scratch.keep(shape, f"{label}-shape").hint("merge"), "bucket").join(signed, "id")
    row, spot = ["bucket", "id", "component", "size", "sig", "keys", "few"], F.xxhash64("id")
    small = placed.where(F.col("n") <= SMALL).select(row).repartition(parts, "bucket").sortWithinPartitions("bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    large = placed.where(F.col("n") > SMALL)
    left = large.select(*row, F.pmod(spot, "lefts").alias("x"), every("rights").alias("y"), F.lit(False).alias("right"))
    right = large.where("component <> main").select(
        *row, every("lefts").alias("x"), F.pmod(spot, "rights").alias("y"), F.lit(True).alias("right")
    )
    both = left.unionByName(right).repartition(parts, "bucket", "x", "y")
    pairs = small.mapInArrow(tidy(lambda batches: _small_buckets(batches, least)), "a long, b long").union(
        both.groupBy("bucket", "x", "y").applyInPandas(lambda pdf: _large_bucket(pdf, least), "a long, b long")
    )
    return pairs.distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    A text without words has an empty set and is linked with nothing.  A row with a null doc_id is linked with nothing
    and kept; its component is null.  Rows that share a doc_id are one document, linked through any of their texts.
    """
    sets = scratch.keep(shingle_sets(docs), "sets")
    known, same = sets.where("doc_id is not null and n_shingles > 0"), ["n_shingles", "set_a", "set_b"]
    reps = known.groupBy(*same).agg(
        F.min("doc_id").alias("id"), *(F.first(c).alias(k) for c, k in (("signature", "sig"), ("bands", "bands"), ("few", "few")))
    )
    reps = scratch.keep(reps.withColumnRenamed("n_shingles", "size"), "reps")
    members = known.select("doc_id", *same).join(
        reps.select(F.col("size").alias("n_shingles"), "set_a", "set_b", F.col("id").alias("rep")).hint("merge"), same
    )
    members = scratch.keep(members.select("doc_id", "rep"), "members")
    lowest = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = lowest.where("low <> high").select("doc_id", "low")
    through_id = members.join(several, "doc_id").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int"))  # four bytes tell two bands apart
    signed = reps.select("id", "size", "sig", keys.alias("keys"), "few")
    placed = reps.select(F.explode("bands").alias("bucket"), "id")
    # Written, so that the join isn't bound to the aggregate's partitions and Spark can split a hot bucket.
    hubs = scratch.keep(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "hubs")
    shared = scratch.keep(placed.join(hubs.hint("merge"), "bucket").select("bucket", "id", "hub"), "shared")

    often = shared.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    star = often.groupBy(F.col("id").alias("b_id")).agg(F.max(F.struct("n", -F.col("hub"))).alias("top"))
    star = star.select("b_id", (-F.col("top.col2")).alias("a_id"))
    as_side = lambda k: reps.select(*(F.col(c).alias(f"{k}_{c}") for c in ("id", "size", "sig", "few")))
    star = star.join(as_side("b"), "b_id").join(as_side("a"), "a_id").where(plausible("a", "b"))
    star = scratch.keep(star.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "star")
    near = components(confirmed(star, docs, scratch, "first").union(through_id), scratch, "one")

    scratch.sweep("hubs", "star", "first", "first-sets")
    sure = THRESHOLD / 100
    large = near.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("component")
    spokes = _placed(shared, near).join(large, "component", "left_semi")
    spokes = scratch.keep(spokes.groupBy("bucket", "component").agg(F.min("id").alias("id")), "spokes-seen")
    pairs = scratch.keep(_across(spokes, signed, scratch, "spokes", parts, sure), "spokes")
    if not pairs.isEmpty():
        near = _merged(near, confirmed(pairs, docs, scratch, "second"), scratch, "two")
    scratch.sweep("spokes", "spokes-seen", "spokes-shape", "second", "second-sets")

    for least, pairs_label, label in ((sure, "clear", "third"), (sure - SLACK, "doubtful", "fourth")):
        seen = scratch.keep(_placed(shared, near), f"{pairs_label}-seen")
        pairs = scratch.keep(_across(seen, signed, scratch, pairs_label, parts, least), pairs_label)
        if not pairs.isEmpty():
            near = _merged(near, confirmed(pairs, docs, scratch, label), scratch, f"{label}-near")
        scratch.sweep(pairs_label, f"{pairs_label}-seen", f"{pairs_label}-shape", label, f"{label}-sets")

    final = lowest.select("doc_id", "low").join(near.withColumnRenamed("id", "low"), "low", "left")
    final = final.select("doc_id", F.coalesce("component", "low").alias("component_id"))
    result = sets.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    result = result.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
    result = scratch.keep(result, "result")
    scratch.sweep("sets", "members", "reps", "shared", "one", "two", "third-near", "fourth-near")
    return result


def _placed(shared: DataFrame, near: DataFrame) -> DataFrame:
    """(bucket, id, component): the members of the buckets with the component that each belongs to by now."""
    return shared.select("bucket", "id").join(near, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))


def _merged(near: DataFrame, links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """near(id, component) after more links between ids: they join components."""
    lifted = links
    for k in "ab":
        side = near.select(F.col("id").alias(k), F.col("component").alias("of"))
        lifted = lifted.join(side, k, "left").withColumn(k, F.coalesce("of", k)).drop("of")
    far = components(lifted.where("a <> b"), scratch, f"{label}-far").withColumnRenamed("component", "further")
    known = near.select("id", F.col("component").alias("of")).unionByName(
        links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(near, "id", "left_anti").select("id", F.col("id").alias("of"))
    )
    joined = known.join(far.withColumnRenamed("id", "of"), "of", "left")
    return scratch.keep(joined.select("id", F.coalesce("further", "of").alias("component")), label)


def drop_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one document of each group, its least doc_id; rows with a null doc_id all stay.

    All columns of docs stay, whatever their names.  Rows that repeat a kept doc_id are one document: of those with a
    text the one with the least stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), scratch)
    p = free_prefix(docs, "near_own_")
    held, kept, n, row = (f"{p}{k}" for k in ("held", "kept", "n", "row"))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias(kept), F.count("*").alias(n))
    # Only ids that go or repeat matter; texts of all others stay where they are.
    ids = scratch.keep(ids.where(f"not {kept} or {n} > 1"), "touched")
    marks = marked(docs, ids, held)
    near = marks.where(held).join(ids, "doc_id", "left").where(f"coalesce({kept}, true)")
    names = [quoted(c) for c in docs.columns]
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    whole = F.struct(empty.alias(f"{p}empty"), F.col("text"), *[F.col(c) for c in names if c != quoted("text")])
    single = near.where(f"{n} > 1").groupBy("doc_id").agg(F.min(whole).alias(row)).select(*[F.col(f"{row}.{c}") for c in names])
    return marks.where(f"not {held}").select(*names).unionByName(near.where(f"{n} is null").select(*names)).unionByName(single)
