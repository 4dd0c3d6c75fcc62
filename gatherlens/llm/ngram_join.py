"""N-gram Jaccard join with filters of several global token orders.

A document's set holds its distinct 5-word shingles (64-bit keyed hashes of the words).
Equal sets are one class.  Two sets x, y link when 100 * |x & y| >= 80 * |x | y|; then
each holds at least 80 % of shingles that the other has too.

1. Shared shingles.  Each task cuts its distinct sets into runs, sorts a run's shingles
   and sends, per range of hashes, one packed block: a shingle of one set with that set,
   a shingle of several sets of the run once, as a mark (its sets are known to share it
   and go on in parts of the run, not by the shingle).  A range's task thus gets one entry per shingle and run,
   however many documents share it.  Sets with less than 80 % of shared shingles link
   with nothing and go; this is the prefix filter for an order that puts shingles of one
   set first.
2. Prefixes.  What is left is ordered globally by the number of sets a shingle is in,
   with ties broken by a different hash for each of ORDERS orders.  A set's prefix under
   an order is as long as needed for any partner to share a shingle of it.
3. Candidates.  Sets that share a prefix shingle of the first order, in neighbouring size
   bands, meet in a list.  Each member is paired with the list's most central set (whose
   shingles are in the most sets); verified links give components.  This goes on with the
   most central sets outside of a list's largest component while it finds links; in the
   end all members of different components of a list are paired.  So a list of copies
   costs its length, and no link between components is lost.  Pairs whose differences from
   the list's pivot, already known, rule out a link are not made.
4. Verification.  A pair must share a prefix shingle under all orders; only then the
   sets are intersected.

Components are joined by star contraction of the links.

The number of links of each document is found afterwards, on request: every link lies in a
component, so all pairs of a component's sets are verified, in bounded blocks of sets of
the same or the neighbouring size band.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherlens.llm.common import chunks, hash_words, mix, staged, tidy, utf8, windows

WORDS, PERCENT, ORDERS = 5, 80, 3
PART = 1 << 17               # entries of a row that goes on without merging
CHUNK = 1 << 20              # bytes of text whose words a task holds
RUN_SHINGLES = 1 << 19       # shingles a task sorts at a time
RANGE_SHINGLES = 1 << 19     # shingles of a range, on average
BLOCK_SETS = 256             # sets and shingles of a component that are compared at a time,
BLOCK_SHINGLES = 1 << 18     # on average
BAND = 1.2500001             # sizes of linked sets differ by a factor of 1.25 at most


def shingle_sets(batch) -> list[np.ndarray]:
    """Sorted distinct shingles of each text of a chunk."""
    words = [t.lower().split() for t in utf8(batch.column("text"))]  # bytes: A-Z and ASCII blanks only
    hashes = hash_words([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        own = hashes[at:at + len(ws)]
        at += len(ws)
        out.append(np.unique(windows(own, min(WORDS, len(own)))) if len(own) else np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches):
    for batch in chunks(batches, "text", CHUNK):
        sets = shingle_sets(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["id", "n", "sid"])


# A block packs entries sorted by shingle: differences of the shingles and numbers of
# their sets, byte by byte (the bytes that are all zero cost nothing once compressed).

def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack(shingles: np.ndarray, sids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    known, which = np.unique(sids, return_inverse=True)
    kind = np.uint8 if len(known) <= 1 << 8 else np.uint16 if len(known) <= 1 << 16 else np.uint32
    return _planes(np.diff(shingles, prepend=np.uint64(0))), known.tobytes(), _planes(which.astype(kind))


def unpack(shingles: bytes, known: bytes, which: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(shingles) // 8
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(which) // n]
    return np.cumsum(_unplanes(shingles, np.uint64)), np.frombuffer(known, np.int64)[_unplanes(which, kind)]


BLOCK = "bucket long, mark boolean, shingles binary, known binary, which binary"


def _blocks(ranges: int):
    def rows(shingles, sids, mark):
        if not len(shingles):
            return []
        bucket = ((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        heads = np.concatenate([[0], cuts])
        return [(int(bucket[h]), mark, *pack(a, b))
                for h, a, b in zip(heads, np.split(shingles, cuts), np.split(sids, cuts))]

    def flush(run, number):
        sids = np.repeat(np.array(list(run), np.int64), [len(s) for s in run.values()])
        shingles = np.concatenate(list(run.values()))
        order = np.argsort(shingles, kind="stable")
        shingles, sids = shingles[order], sids[order]
        new = np.ones(len(shingles), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        last = np.append(new[1:], True)
        many = ~(new & last)
        heads = many & new
        out = rows(shingles[~many], sids[~many], False)
        out += rows(shingles[heads], sids[heads], True)
        # Known to be shared: nothing to merge, so they are dealt by set and run.
        shingles, sids = shingles[many], sids[many]
        order = np.argsort(sids, kind="stable")
        shingles, sids = shingles[order], sids[order]
        for i, a in enumerate(range(0, len(sids), PART)):
            out.append((-1 - (number * RUN_SHINGLES + i), None, *pack(shingles[a:a + PART], sids[a:a + PART])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.binary(),
                                                                      pa.binary()))],
            names=["bucket", "mark", "shingles", "known", "which"])

    def run_all(batches):
        run, held = {}, 0
        number = TaskContext.get().partitionId() << 20
        for batch in chunks(batches, "text", CHUNK):
            for s in shingle_sets(batch):
                if not len(s):
                    continue
                sid = set_id(s)
                if sid not in run:
                    run[sid] = s
                    held += len(s)
                if held >= RUN_SHINGLES:
                    yield flush(run, number)
                    run, held = {}, 0
                    number += 1
        if run:
            yield flush(run, number)
    return tidy(run_all)


def _shared(table: pa.Table) -> pa.Table:
    """Of a range's blocks: the entries shared by several sets, as rows of two lists (sids,
    shingles) of the same length."""
    parts, marks = [], []
    for r in table.to_pylist():
        a, b = unpack(r["shingles"], r["known"], r["which"])
        parts.append((a, b))
        marks.append(np.full(len(a), 2 if r["mark"] is None else int(r["mark"]), np.int8))
    shingles, sids = (np.concatenate(x) for x in zip(*parts))
    marks = np.concatenate(marks)
    if marks[0] == 2:  # all of them known to be shared
        return _listed(sids, shingles)
    # One entry for each shingle, set and kind: copies of a set come from several runs.
    order = np.lexsort((marks, sids, shingles))
    shingles, sids, marks = shingles[order], sids[order], marks[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (sids[1:] != sids[:-1]) | (marks[1:] != marks[:-1])
    shingles, sids, marks = shingles[new], sids[new], marks[new]
    heads = np.flatnonzero(np.diff(shingles, prepend=~shingles[:1]) != 0)
    sizes = np.diff(np.append(heads, len(shingles)))
    marked = np.add.reduceat((marks > 0).astype(np.int64), heads) > 0
    # Entries of one set only, mark and all, come from several runs that hold that set.
    keep = np.repeat((sizes >= 2) | marked, sizes) & (marks != 1)
    shingles, sids = shingles[keep], sids[keep]
    order = np.argsort(sids, kind="stable")
    return _listed(sids[order], shingles[order])


def _listed(sids: np.ndarray, shingles: np.ndarray) -> pa.Table:
    cuts = pa.array(np.append(np.arange(0, len(sids), PART), len(sids)), pa.int32())
    return pa.table({"sids": pa.ListArray.from_arrays(cuts, pa.array(sids, pa.int64())),
                     "shingles": pa.ListArray.from_arrays(cuts, pa.array(shingles.view(np.int64)))})


def needed(n: int) -> int:
    """Shingles that a set of ``n`` shares with any partner, at least."""
    return -(-PERCENT * n // 100)


def _lists(column) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _prefixes(batches):
    """(sid, n, shingles, band, prefix per order) of sets that can have a partner."""
    for batch in batches:
        out = []
        for sid, n, own, df in zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(),
                                   _lists(batch.column("shingles")), _lists(batch.column("df"))):
            length = len(own) - needed(n) + 1
            if length < 1:
                continue
            row = {"sid": sid, "n": n, "shingles": np.sort(own), "band": int(np.log(n) / np.log(BAND)),
                   "alone": n - len(own), "centre": round(float(df.sum()) / n, 6)}
            for k in range(ORDERS):
                ties = mix(own.view(np.uint64) + np.uint64(k * 0x9E3779B9))
                row[f"prefix{k}"] = own[np.lexsort((ties, df))[:length]]
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, PREFIX)


PREFIX = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64())), ("band", pa.int32()),
                    ("alone", pa.int64()), ("centre", pa.float64()),
                    *[(f"prefix{k}", pa.list_(pa.int64())) for k in range(ORDERS)]])
PREFIX_SQL = "sid long, n long, shingles array<long>, band int, alone long, centre double, " + ", ".join(
    f"prefix{k} array<long>" for k in range(ORDERS))


def _verified(batches):
    """Of pairs that pass the filters of all orders: the size of the sets' symmetric
    difference, and whether they link."""
    for batch in batches:
        col = {n: _lists(batch.column(n)) for n in batch.schema.names if n[2:] == "shingles" or n[2:].startswith("prefix")}
        na, nb = batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist()
        keep, differ, linked = [], [], []
        for i in range(batch.num_rows):
            if all(len(np.intersect1d(col[f"a_prefix{k}"][i], col[f"b_prefix{k}"][i], assume_unique=True))
                   for k in range(ORDERS)):
                both = len(np.intersect1d(col["a_shingles"][i], col["b_shingles"][i], assume_unique=True))
                keep.append(i)
                differ.append(na[i] + nb[i] - 2 * both)
                linked.append(100 * both >= PERCENT * (na[i] + nb[i] - both))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")],
                                          pa.array(differ, pa.int64()), pa.array(linked, pa.bool_())],
                                         names=["a", "b", "differ", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    side = [c for c in sets.columns if c not in ("band", "alone", "centre", "sid")]
    # Few sets are in pairs after the first round: the others do not go through the exchanges.
    paired = staged(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "paired")
    sets = sets.join(paired, "sid", "left_semi")
    for p in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in side]), p)
    pairs = pairs.where(f"100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n)")
    return staged(pairs.mapInArrow(tidy(_verified), "a long, b long, differ long, linked boolean"), name)


def components(links: DataFrame) -> DataFrame:
    """(sid, label) of every set with a link: the smallest set id of its component.
    Large-star and small-star steps alternate until the edges are stars; each step is
    staged, and only counts come to the driver."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # Every greater neighbour of a node is tied to the node's least neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        # Every smaller neighbour, and the node, are tied to the least one.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        edges = new
        # Stars: each node points to one head, and no head points on.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            break
    return staged(edges.select(F.col("u").alias("sid"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct()), "labels")


def link_sets(docs: DataFrame, sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different sets: all that join components, not all within; and
    the sets that can have a partner."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-int(total) // RANGE_SHINGLES))
    shared = staged(docs.select("text").mapInArrow(_blocks(ranges), BLOCK).groupBy("bucket").applyInArrow(
        tidy(_shared), "sids array<long>, shingles array<long>"), "shared")
    # A set's copies may repeat shingles, so their number is an upper bound: it prunes.
    held = staged(shared.select(F.explode("sids").alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("held")).join(
        classes.select("sid", "n"), "sid").where(f"100 * held >= {PERCENT} * n").select("sid", "n"), "likely")
    entries = shared.select(F.inline(F.arrays_zip("sids", "shingles"))).select(F.col("sids").alias("sid"), F.col("shingles").alias("shingle"))
    tokens = staged(entries.join(held.select("sid"), "sid").distinct(), "tokens")
    df = staged(tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    counted = tokens.join(df, "shingle").groupBy("sid").agg(F.collect_list("shingle").alias("shingles"),
                                                            F.collect_list("df").alias("df"))
    prefixed = staged(counted.join(held, "sid").select("sid", "n", "shingles", "df").mapInArrow(tidy(_prefixes), PREFIX_SQL),
                      "prefixes")
    # A set of band b meets bands b and b + 1 in list b, and b - 1 and b in list b - 1.
    posts = staged(prefixed.select("sid", "n", "alone", "centre", F.explode("prefix0").alias("shingle"), "band").select(
        "sid", "n", "alone", "centre", "shingle", F.explode(F.array("band", F.col("band") - 1)).alias("list")), "postings")
    # Lists of one member pair nothing; of lists with the same members one is enough.
    lists = posts.groupBy("shingle", "list").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("h1"),
                                                 F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("h2")).where("size > 1")
    lists = staged(lists.groupBy("size", "h1", "h2").agg(F.min(F.struct("shingle", "list")).alias("l")).select("l.*"), "lists")
    posts = staged(posts.join(lists, ["shingle", "list"]), "list-members")
    return _joined(posts, prefixed), prefixed


LIST = ["shingle", "list"]


def _joined(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links that join all sets of the lists that links can join."""
    named, links, tried = posts.withColumn("label", F.col("sid")), None, None
    most = F.struct("centre", "sid", "label")
    while True:
        # Only lists whose members are not all of one component yet.
        sizes = named.groupBy(*LIST, "label").agg(F.count(F.lit(1)).alias("size"))
        mixed = staged(sizes.groupBy(*LIST).agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
                       .where("labels > 1").select(*LIST, F.col("most.label").alias("major")), "mixed-lists")
        inside = staged(named.join(mixed, LIST), "mixed-members")
        # Two pivots: the most central member of all, and outside of the largest component.
        pivots = inside.groupBy(*LIST).agg(F.max(most).alias("p"), F.max(F.when(F.col("label") != F.col("major"), most)).alias("q"))
        first = pivots.select(*LIST, F.col("p.sid").alias("pivot"), F.col("p.label").alias("p_label"))
        second = pivots.select(*LIST, F.col("q.sid").alias("pivot"), F.col("q.label").alias("p_label"))
        first = staged(first if tried is None else first.union(second).distinct(), "pivots")
        pairs = inside.join(first, LIST).where("label <> p_label").select(
            F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pivot-pairs")
        found = _verify(pairs, sets, "pivot-links")
        if tried is None:
            # Each member's difference from the list's first pivot, where it was verified.
            far = found.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "differ").union(
                found.select(F.col("b").alias("sid"), F.col("a").alias("pivot"), "differ"))
            posts = staged(posts.join(first.select(*LIST, "pivot"), LIST).join(far, ["sid", "pivot"], "left").withColumn(
                "differ", F.when(F.col("sid") == F.col("pivot"), 0).otherwise(F.col("differ"))).withColumnRenamed("pivot", "hub"), "measured")
        tried = pairs if tried is None else staged(tried.union(pairs), "tried")
        new = found.where("linked").select("a", "b")
        links = new if links is None else staged(links.union(new), "links")
        if new.isEmpty():
            break
        named = staged(posts.join(components(links), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "named")
    # What pivots do not join any more: of the members of such lists with one first pivot
    # (the hub), all outside of the largest component against all of other components that
    # the bound lets through.
    if "hub" not in inside.columns:  # no pivot has a link
        inside = inside.join(posts.select(*LIST, "sid", "differ", "hub"), [*LIST, "sid"])
    one = ["label", "sid", "n", "alone", "differ"]
    around = staged(inside.select("hub", *one).distinct(), "around-hubs")
    sizes = around.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("size"))
    around = around.join(staged(sizes.groupBy("hub").agg(F.max(F.struct("size", "label")).alias("m")).select(
        "hub", F.col("m.label").alias("major")), "majors"), "hub")
    minor = around.where("label <> major").select("hub", *[F.col(c).alias(f"x_{c}") for c in one])
    across = around.join(minor, "hub").where("label <> x_label AND (label = major OR sid < x_sid)").where(NEAR).select(
        F.least("sid", "x_sid").alias("a"), F.greatest("sid", "x_sid").alias("b")).distinct()
    across = staged(across.join(tried, ["a", "b"], "left_anti"), "across-pairs")
    return staged(links.union(_verify(across, sets, "across-links").where("linked").select("a", "b")), "all-links")


# Let D(x) be the symmetric difference of x and the list's pivot.  x and y differ by
# |D(x)| + |D(y)| - 2 |D(x) & D(y)|, which is a ninth of their sizes at most if they link
# (for 80 %).  A shingle that x has alone is in D(x) and not in D(y), so the intersection is
# |D(x)| - alone(x) at most, and likewise for y.  Pairs beyond this bound can't link.
NEAR = ("coalesce(18 * least(differ - alone, x_differ - x_alone) >= 9 * (differ + x_differ) - (n + x_n), true)")


def _counted(table: pa.Table) -> pa.Table:
    """Of two blocks (or one, with itself): (sid, partners), the documents of the sets that
    each set links with."""
    table = table.combine_chunks()
    sid, n, copies, side = (table.column(c).to_numpy() for c in ("sid", "n", "copies", "side"))
    lists = _lists(table.column("shingles").chunk(0))
    row = np.repeat(np.arange(len(sid)), [len(x) for x in lists])
    _, column, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    many = held[column] > 1
    number = np.cumsum(held > 1) - 1  # of the shingles that two sets have
    row, column = row[many], number[column[many]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # Either block may be empty, so the names tell whether it is one block.
    alone = all(table.column(f"{c}1")[0] == table.column(f"{c}2")[0] for c in ("band", "block"))
    a = np.flatnonzero(side == 0)
    b = a if alone else np.flatnonzero(side == 1)
    both = np.zeros((len(a), len(b)), np.int64)
    step = max(1, (1 << 22) // len(sid))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        part = slice(*np.searchsorted(column, [start, start + step]))
        bits = np.zeros((len(sid), step), np.float32)  # sums of less than 2 ** 24 are exact
        bits[row[part], column[part] - start] = 1
        both += (bits[a] @ bits[b].T).astype(np.int64)
    linked = 100 * both >= PERCENT * (n[a][:, None] + n[b][None, :] - both)
    if alone:
        np.fill_diagonal(linked, False)
    partners = np.zeros(len(sid), np.int64)
    partners[a] = linked @ copies[b]
    if not alone:
        partners[b] = linked.T @ copies[a]
    return pa.table({"sid": pa.array(sid, pa.int64()), "partners": pa.array(partners, pa.int64())})


def count_links(classes: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, partners) of every set with a label: the documents of other sets that it links
    with, from all pairs of its component.  A component that fits is one block; others are
    cut by size band, and bands by a hash of the set.  Sets of a band meet their own band
    and the next one; what leaves a task is a sum per set and block, not pairs."""
    held = staged(sets.join(labels, "sid").join(classes.select("sid", "copies"), "sid").select(
        "sid", "n", "copies", "label", "band", "shingles"), "component-sets")
    sums = staged(held.groupBy("label", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("shingles")).alias("held")),
                  "bands")

    def blocks():
        return F.ceil(F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("held") / BLOCK_SHINGLES)).alias("blocks")

    whole = staged(sums.groupBy("label").agg(blocks()).where("blocks = 1").select("label"), "one-block")
    cut = staged(sums.join(whole, "label", "left_anti").groupBy("label", "band").agg(blocks()), "many-blocks")
    one = held.join(whole, "label").select("sid", "n", "copies", "shingles", "label", *[F.lit(0).alias(c) for c in PAIR[1:]],
                                           F.lit(0).alias("side"))
    units = staged(cut.select("label", "band", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block")),
                   "blocks")
    first = units.select("label", F.col("band").alias("band1"), F.col("block").alias("block1"))
    second = units.select("label", F.col("band").alias("band2"), F.col("block").alias("block2"))
    pairs = staged(first.join(second, "label").where("band2 = band1 + 1 OR (band2 = band1 AND block2 >= block1)"), "block-pairs")
    sides = pairs.select(*PAIR, F.col("band1").alias("band"), F.col("block1").alias("block"), F.lit(0).alias("side")).union(
        pairs.where("band1 <> band2 OR block1 <> block2").select(
            *PAIR, F.col("band2").alias("band"), F.col("block2").alias("block"), F.lit(1).alias("side")))
    dealt = held.join(cut, ["label", "band"]).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    some = dealt.join(sides, ["label", "band", "block"]).select("sid", "n", "copies", "shingles", *PAIR, "side")
    met = one.union(some).groupBy(*PAIR).applyInArrow(tidy(_counted), "sid long, partners long")
    return staged(met.groupBy("sid").agg(F.sum("partners").alias("partners")), "partners")


PAIR = ["label", "band1", "block1", "band2", "block2"]


def join_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id (smallest id
    reachable by links) and n_copies (rows with the same set); with ``n_links`` also the
    number of other rows that it links with, copies counted one by one.

    Lower-cases A-Z; texts of fewer than five words are one shingle; null and wordless
    texts have none, link with nothing and are their own component.  Rows that share an
    id are documents of their own; null ids count only if a component has no other.
    Other columns play no part.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sets = staged(docs.mapInArrow(tidy(_sets), f"id {kind}, n long, sid long"), "sets")
    classes = staged(sets.where("sid IS NOT NULL").groupBy("sid").agg(
        F.first("n").alias("n"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "classes")
    links, partnered = link_sets(docs, sets, classes)
    labels = components(links)
    linked = staged(classes.join(labels, "sid").select("sid", "label", "least_id"), "linked")
    heads = staged(linked.groupBy("label").agg(F.min("least_id").alias("component")), "heads")
    named = staged(classes.select("sid", "copies", "least_id").join(
        linked.join(heads, "label").select("sid", "component"), "sid", "left").select(
        "sid", "copies", F.coalesce("component", "least_id").alias("component")), "named-classes")
    out = sets.join(named, "sid", "left")
    if n_links:
        out = out.join(count_links(classes, labels, partnered), "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
                      *([(F.coalesce("partners", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")] if n_links else []))
