"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what is linked through them.

Rows with equal sets are put together first. Candidates are sets whose SimHash fingerprints differ in three bits at most, and sets
that agree in one of BANDS bands of BAND_ROWS least hashes each: at similarity 0.8 a pair of sets misses all bands with a chance of
7 in 100,000, and less above. A band's sets are linked to the least of them, so rows stay linear. A cluster of such links of at most
CLUSTER_SETS sets with CLUSTER_SHINGLES shingles comes together once, in one task; there all pairs that share one of their rarest
shingles are compared by their whole sets, which near copies always do, and only links that the comparison confirms count.

A larger cluster never does. Each of its sets is compared with PIVOTS of them, in chunks of rows. One minus the similarity is a
metric, so a set linked to a pivot is settled where every set of another class is farther from that pivot than its own distance and
that of a link together; pivots are settled always. What is left is dealt once by its bands, and that goes on with new pivots until
each group has one class or fits one task. So no link of a band is lost, whatever the size of a group.

Defined cases: texts without words are one class; fewer words than a shingle are one shingle. A row is known by all its columns, so
rows without an id and rows that repeat one with another text are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, blocks, mix, small_batches, store
from .components import components
from .simhash import links, shingles, votes

SHINGLE, BANDS, BAND_ROWS = 5, 24, 5
#: Similarity from which two texts are near copies, as a fraction.
LEAST = (4, 5)
#: Sets, and shingles of all sets together, of a cluster that comes together in one task; rows of a chunk of a larger one.
CLUSTER_SETS, CLUSTER_SHINGLES, CHUNK_ROWS = 8192, 4_000_000, 512
#: Sets that all of a larger cluster are compared with at once, before and after it is dealt by bands.
PIVOTS = (16, 512)
_TURN = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(_TURN) | np.uint64(1)


def sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and text numbers of all shingles of a block, and of each text's distinct ones in order."""
    hashes, of = shingles(offsets, data, SHINGLE)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return hashes, of, h[new], o[new]


def bands(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The key of each band for each set; sets start at `edges`."""
    out = np.zeros((len(edges), BANDS), np.uint64)
    for i in range(BANDS * BAND_ROWS):
        least = np.minimum.reduceat((h ^ _TURN[i]) * _TIMES[i], edges)
        out[:, i // BAND_ROWS] = mix(out[:, i // BAND_ROWS] * np.uint64(31) + least + np.uint64(i))
    return out


def described(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
    """Of each text: name of its set, fingerprint, keys of its bands, size of its set; a text without words has no keys."""
    n = len(offsets) - 1
    hashes, of, h, o = sets(offsets, data)
    name, keys = np.zeros(n, np.uint64), np.zeros((0, BANDS), np.uint64)
    full, edges = np.unique(o, return_index=True)
    if len(full):
        name[full] = mix(np.add.reduceat(mix(h), edges) + np.diff(np.append(edges, len(h))).astype(np.uint64))
        keys = bands(h, edges)
    ends = np.concatenate(([0], np.cumsum(np.isin(np.arange(n), full)))).astype(np.int32) * BANDS
    return [pa.array(name.view(np.int64)), pa.array(votes(hashes, of, n).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))), pa.array(np.bincount(o, minlength=n))]


def common_of(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two ordered sets share."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def confirmed(members: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of all pairs of sets that are near copies.

    Near copies share a shingle among the rarest of each, as many as may be missing and one more. So a set is compared with those
    before it that hold one of its rare shingles among theirs, where what follows the first of these in both is enough, and not with
    sets of its class."""
    n, root, up, down = len(members), np.arange(len(members)), *LEAST
    size = np.array([len(m) for m in members])
    owner = np.repeat(np.arange(n), size)
    _, shingle, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    by = np.lexsort((shingle, count[shingle], owner))  # rare ones first
    place = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
    few = (place < (size - (up * size + down - 1) // down + 1)[owner]) & (count[shingle[by]] > 1)
    rare, of, left = shingle[by][few], owner[few], (size[owner] - place)[few]  # left: shingles from here on
    dealt = np.argsort(rare, kind="stable")
    holders, theirs, first = of[dealt], left[dealt], np.searchsorted(rare[dealt], rare)
    before = np.empty(len(rare), np.int64)
    before[dealt] = np.arange(len(rare))
    found: list[tuple[int, int]] = []
    tried, sizes = np.full(n, -1), np.ones(n, np.int64)  # of classes, by their root
    for at in range(len(rare)):
        b = int(of[at])
        if sizes[root[b]] == b + 1:  # all sets up to this one are of its class
            continue
        some, most = holders[first[at] : before[at]], np.minimum(theirs[first[at] : before[at]], left[at])
        new = (root[some] != root[b]) & (tried[some] != b)
        tried[some] = b
        for a in some[new & ((up + down) * most >= up * (size[some] + size[b]))].tolist():
            if root[a] == root[b]:
                continue
            common = common_of(members[a], members[b])
            if down * common >= up * (size[a] + size[b] - common):
                found.append((a, b))
                low, high = sorted((root[a], root[b]))
                sizes[low] += sizes[high]
                root[root == high] = low
    return found


def _members(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each row, from its text or from the bytes that hold it."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        for raw in column:
            yield np.frombuffer(raw.as_py(), np.uint64)
        return
    for _, offsets, data in blocks(column):
        _, _, h, o = sets(offsets, data)
        edges = np.searchsorted(o, np.arange(len(offsets))).tolist()
        for i in range(len(offsets) - 1):
            yield h[edges[i] : edges[i + 1]].copy()


def _confirmed_links(rows: DataFrame) -> DataFrame:
    """rows: cluster, name, text or members; those of a cluster come together and in order of names."""

    def answer(names: list[int], members: list[np.ndarray]) -> pa.RecordBatch:
        pairs = confirmed(members)
        return pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in pairs], pa.int64()), pa.array([names[b] for _, b in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        names: list[int] = []
        members: list[np.ndarray] = []
        for batch in batches:
            for cluster, name, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _members(batch.column(2))):
                if cluster != here:
                    if len(names) > 1:
                        yield answer(names, members)
                    here, names, members = cluster, [], []
                if not names or names[-1] != name:
                    names.append(name)
                    members.append(mine)
        if len(names) > 1:
            yield answer(names, members)

    dealt = rows.repartition("cluster").sortWithinPartitions("cluster", "name")
    return small_batches(dealt).mapInArrow(run, "a bigint, b bigint")


def _as_sets(texts: DataFrame) -> DataFrame:
    """name, members (the set's numbers in order, as bytes) of rows (name, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in _members(batch.column(1))], pa.binary())], names=["name", "members"])

    return small_batches(texts).mapInArrow(run, "name bigint, members binary")


def _to_pivots(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (group, name, pivot, distance, near) of a set and a pivot of its group that are not farther than two links.

    rows and pivots: group, chunks (how many the group is split into), name, members. A task holds the pivots of one chunk only.
    """
    up, down = LEAST
    chunk = F.pmod(F.xxhash64("name"), F.col("chunks")).alias("chunk")
    own = rows.select("group", chunk, F.lit(1).alias("turn"), "name", "members")
    asked = pivots.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("turn"), "name", "members")
    dealt = own.union(asked).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        held: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            found: list[tuple] = []
            for group, part, turn, name, mine in zip(*(batch.column(i).to_pylist() for i in range(4)), _members(batch.column(4))):
                if here != (group, part):
                    here, held = (group, part), []
                if turn == 0:
                    held.append((name, mine))
                    continue
                for pivot, other in held:
                    if down * min(len(other), len(mine)) < (2 * up - down) * max(len(other), len(mine)):
                        continue
                    common = common_of(other, mine)
                    union = len(other) + len(mine) - common
                    if down * common >= (2 * up - down) * union:
                        found.append((group, name, pivot, 1 - common / union, down * common >= up * union))
            columns = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["group", "name", "pivot", "distance", "near"])

    return small_batches(dealt).mapInArrow(run, "group bigint, name bigint, pivot bigint, distance double, near boolean")


def large_links(rows: DataFrame, members: DataFrame, cluster_sets: int, cluster_shingles: int, pivots: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join all near copies of a band in groups too large for one task.

    rows: group, name, keys, n_shingles; members: name, members. Each round takes that many sets (first, later) out of every large group, so it ends.
    """
    reach = (LEAST[1] - LEAST[0]) / LEAST[1] + 1e-9
    whole, found, first = rows.withColumn("class", F.col("name")), None, True
    small = None
    while True:
        of = whole.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min("class").alias("low"), F.max("class").alias("high"))
        of = of.where("low != high").select("group", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"), ((F.col("n") <= cluster_sets) & (F.col("shingles") <= cluster_shingles)).alias("fits"))
        sized = store(whole.join(of, "group"), "near-groups")
        fitting, large = sized.where("fits").select(F.col("group").alias("cluster"), "name"), sized.where(~F.col("fits"))
        small = fitting if small is None else small.union(fitting)
        if large.isEmpty():
            break
        turn = F.row_number().over(Window.partitionBy("group").orderBy("name"))
        leading = store(large.select("group", "chunks", "name", "class").withColumn("turn", turn).where(F.col("turn") <= pivots[0 if first else 1]).drop("turn"), "near-pivots")
        ids = ["group", "chunks", "name", "members"]
        pairs = store(_to_pivots(large.join(members, "name").select(ids), leading.join(members, "name").select(ids)), "near-pairs")
        new = pairs.where("near AND name != pivot").select(F.col("name").alias("a"), F.col("pivot").alias("b"))
        found = new if found is None else found.union(new)
        classes = store(components(found).toDF("name", "root"), "near-classes")
        rooted = lambda df: df.drop("class").join(classes, "name", "left").withColumn("class", F.coalesce("root", "name")).drop("root")
        heads = rooted(leading).select("group", F.col("name").alias("pivot"), F.col("class").alias("head"))
        other = rooted(pairs).join(heads, ["group", "pivot"]).where("class != head").groupBy("group", "pivot").agg(F.min("distance").alias("nearest"))
        settled = pairs.where("near").join(other, ["group", "pivot"], "left").where(F.col("nearest").isNull() | (F.col("distance") + reach < F.col("nearest")))
        settled = settled.select("group", "name").union(leading.select("group", "name")).distinct()
        whole = rooted(large.drop("chunks", "fits").join(settled, ["group", "name"], "left_anti"))
        if first:
            whole = whole.select("group", "name", "n_shingles", "class", F.posexplode("keys").alias("band", "key"))
            whole, first = whole.withColumn("group", F.xxhash64("group", "band", "key")).drop("band", "key"), False
    compared = _confirmed_links(small.join(members, "name").select("cluster", "name", "members"))
    return compared if found is None else compared.union(found)


def row_key(columns: list[str]) -> Column:
    """Never null, and another one for rows that differ in any column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def keep_first(
    df: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", cluster_sets: int = CLUSTER_SETS, cluster_shingles: int = CLUSTER_SHINGLES, pivots: tuple[int, int] = PIVOTS
) -> DataFrame:
    """Of each class of near copies the row with the least id; one without an id only where none has one."""
    keyed = df.select(*columns, row_key(columns).alias("row_key"))
    each = store(append_columns(keyed, text_col, ["row_key", id_col], "name bigint, fp bigint, keys array<bigint>, n_shingles bigint", described), "near-copies")
    distinct = store(each.where(F.size("keys") > 0).groupBy("name").agg(F.min("row_key").alias("row_key"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles")), "near-sets")
    by_band = distinct.select("name", F.posexplode("keys").alias("band", "key"))
    least = by_band.groupBy("band", "key").agg(F.min("name").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = by_band.join(least, ["band", "key"]).where("name != least").select(F.col("name").alias("a"), F.col("least").alias("b")).distinct()
    # fingerprints: equal ones, and those a few bits apart
    prints = store(distinct.groupBy("fp").agg(F.min("name").alias("least")), "near-prints")
    edges = edges.union(distinct.join(prints, "fp").where("name != least").select("name", "least"))
    close = links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    edges = edges.union(close.select("x", "y"))
    clusters = components(edges).toDF("name", "cluster").join(distinct, "name")
    of = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    of = store(of.where((F.col("n") > cluster_sets) | (F.col("shingles") > cluster_shingles)).select("cluster"), "near-large")
    texts = keyed.select("row_key", F.col(text_col).alias("text"))
    confirmed_links = _confirmed_links(texts.join(clusters.join(of, "cluster", "left_anti").select("cluster", "name", "row_key"), "row_key").select("cluster", "name", "text"))
    if not of.isEmpty():
        large = store(clusters.join(of, "cluster", "left_semi").select(F.col("cluster").alias("group"), "name", "row_key", "keys", "n_shingles"), "near-large-rows")
        members = store(_as_sets(texts.join(large.select("name", "row_key"), "row_key").select("name", "text")).dropDuplicates(["name"]), "near-members")
        confirmed_links = confirmed_links.union(large_links(large.drop("row_key"), members, cluster_sets, cluster_shingles, pivots))
    classes = components(confirmed_links).toDF("name", "class")
    rooted = each.select("name", "row_key", id_col).join(classes, "name", "left").withColumn("class", F.coalesce("class", "name"))
    first = rooted.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("row_key"))).alias("least")).select(F.col("least.row_key").alias("row_key"))
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*columns)
