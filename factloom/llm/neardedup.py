"""Near-duplicate detection by HyperMinHash.

Words: ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's set is its distinct k-word shingles (a shorter document
is one shingle). Documents are linked if 100 * intersection >= 80 * union, and a link is always confirmed on the full sets.

1. A register for each of BUCKETS hash functions holds the leading zeros (6 bits) and the next mantissa bits (10) of the
   smallest hash. Each bucket hashes all shingles, since in a short document averaged buckets would stay empty.
2. Equal sets (by their 128-bit digest) are one class; what follows sees one row for each class.
3. Bands of registers are dealt by their hash. In each bucket of a band the first class is the hub, and every other is a
   candidate of the hub: as many candidates as members, however large the bucket.
4. Candidates are ranked by the collision-corrected estimate; each class's best are verified on the full sets, and
   components are built from the links.
5. Buckets that hold several components still may hide a link. While those of more than BLOCK members need many comparisons,
   each of them gets a further hub, from a component that no hub of theirs stands in; a round is linear in the members. Rounds
   end once one has not halved the comparisons: members that are linked with nothing would else need a round each.
6. In the buckets left, members are compared in blocks, each against those outside the bucket's largest component, and each
   pair in the first band it shares: by sizes and estimate at first, then, for members that have such a pair, on the full
   sets inside the same blocks. Tasks return each member or link once, never pairs, and components are built again. So no
   pair of a bucket is left out unless it is connected already.

A pair of similarity 0.8 meets in no band with probability (1 - 0.8 ** ROWS) ** BANDS, under 1e-9, and falls under the estimate's
margin of 4.5 standard deviations with probability under 1e-5.

Defined cases: null text, empty text and text without words have an empty set, and are linked with nothing; a very long
text is hashed whole, its registers in pieces; repeated rows are one class; ties (equal estimates, equal smallest ids) are
settled by the class's number, and cannot change a component; a null doc_id belongs to no component but its class's; other
columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_keys, key_filter, keyed, read_table, stored, text_list
from .components import connected_components

BANDS, ROWS = 40, 4
BUCKETS, MANTISSA = BANDS * ROWS, 10
THRESHOLD = 80
#: Estimates this far (standard deviations) under the threshold are still verified.
MARGIN = 4.5
#: Verified first for each class: its best candidates by estimate.
BEST = 2
#: Members of a bucket that are compared in one task, and their shingles where full sets are compared.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Comparisons that hub rounds are worth, in full blocks: they take some 100 CPU seconds, a round some twenty jobs.
ROUND_BLOCKS = 64
_random = np.random.Generator(np.random.PCG64(20240229))
_PLACE = _random.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_FACTOR = _random.integers(1, 1 << 63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, BUCKETS, dtype=np.uint64) * np.uint64(2)
_BAND = _random.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word: a sum of its bytes times a random number for each place, mixed with its length."""
    a = np.frombuffer(raw.lower(), np.uint8)
    gap = _SPACE[a]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    a, gap = a[starts[0] :], gap[starts[0] :]
    starts = starts - starts[0]
    sizes = np.add.reduceat((~gap).astype(np.int64), starts)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(starts, append=len(a)))
    if sizes.max() > len(_PLACE):
        wrap = place // len(_PLACE)
        product = (a.astype(np.uint64) + np.uint64(1)) * (_PLACE[place % len(_PLACE)] * _mix(wrap.astype(np.uint64) + np.uint64(7)) | np.uint64(1))
    else:
        product = (a.astype(np.uint64) + np.uint64(1)) * _PLACE[np.minimum(place, len(_PLACE) - 1)]
    product[gap] = 0
    return _mix(np.add.reduceat(product, starts) ^ (sizes.astype(np.uint64) << np.uint64(48)))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash of each bucket; a long set goes through in pieces."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        h = np.multiply.outer(shingles[at : at + 512], _FACTOR)
        h += _SHIFT
        np.minimum(least, h.min(axis=0), out=least)
    # A float's exponent is the place of the leading one, and its top mantissa bits are those that follow.
    bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64)
    return ((bits >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less those that different minima share by chance.

    Two independent minima of sets of n and m share a register with probability about
    2 ** -(MANTISSA + 1) / ln 2 * n m / (n + m) ** 2.
    """
    n, m, equal = n.astype(np.float64), m.astype(np.float64), np.asarray(equal, np.float64)
    chance = 2.0 ** -(MANTISSA + 1) / np.log(2) * n * m / np.maximum(n + m, 1) ** 2
    return (equal / BUCKETS - chance) / (1 - chance)


def least_estimate(threshold: int = THRESHOLD) -> float:
    j = threshold / 100
    return j - MARGIN * (j * (1 - j) / BUCKETS) ** 0.5


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, k) for t in text_list(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "registers"],
                )

    return run


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        ids, sizes = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("id", "n"))
        h = np.zeros(regs.shape[:2], np.uint64)
        for i in range(ROWS):
            h = _mix(h + (regs[:, :, i] + np.uint64(1)) * _BAND[None, :, i])
        h = _mix(h ^ _BAND[None, :, ROWS])
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(band), pa.array(ids), pa.array(sizes)], ["bucket", "band", "id", "n"])


def _estimates(low: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("registers_a", "registers_b"))
            est = estimate((x == y).sum(1), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = pa.array(est >= low)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est).filter(keep)], ["a", "b", "est"])

    return run


def _confirm(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in text_list(batch.column("text"))]
            right = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(right, pa.bool_())), pa.array([s.tobytes() for s, r in zip(sets, right, strict=True) if r], pa.binary())], ["id", "set"])

    return run


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, set of the classes in ids (distinct), made anew from the text of one document of each class."""
    wanted = stored(classes.join(ids, "id").select("id", "digest", F.col("first_doc").alias("_doc")), "wanted")
    n = wanted.count()
    if n * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    elif among := key_filter(wanted.select("_doc"), n):  # other texts are not shuffled
        docs = docs.where(among(F.col("doc_id")))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "digest", "text")
    return texts.mapInArrow(_sets(k), "id long, set binary")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(full_sets(docs, classes, ids, k).dropDuplicates(["id"]), "sets")
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(threshold), "a long, b long")


class _Group:
    """Rows of one bucket, block of members and block of outsiders: members first, then outsiders."""

    def __init__(self, rows: dict[str, np.ndarray | list], begin: int, end: int):
        cut = begin + int(np.searchsorted(rows["side"][begin:end], 1))
        self.bucket, self.band = int(rows["bucket"][begin]), int(rows["band"][begin])
        self.left, self.right = ({k: v[a:b] for k, v in rows.items()} for a, b in ((begin, cut), (cut, end)))


def _groups(batches, columns: tuple[str, ...]):
    """Lists of groups, from batches that are sorted by bucket, i, j and side; a group may cross batches."""
    held = None

    def read(batch, starts, ends):
        rows = {c: batch.column(c).to_numpy() for c in ("bucket", "band", "id", "component", "n", "side")}
        rows["registers"] = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        rows |= {c: batch.column(c).to_pylist() for c in columns}
        return [_Group(rows, a, b) for a, b in zip(starts, ends, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
        done = batch.slice(0, starts[-1])
        if done.num_rows:
            yield read(done, starts[:-1], starts[1:])
        held = batch.slice(starts[-1])
    if held is not None:
        yield read(held, [0], [held.num_rows])


def _open_pairs(g: _Group, low: float, threshold: int):
    """Pairs between components that may be linked: numbers of the outsider and of the member, and the estimate; some at a time.

    A pair is looked at only in the first band that it shares; sizes must allow the threshold, the estimate must reach low.
    """
    x, sizes, comps = g.left["registers"], g.left["n"], g.left["component"]
    y, own_sizes, own = g.right["registers"], g.right["n"], g.right["component"]
    step, least = max(1, 4096 // max(1, len(x))), int(low * BUCKETS)
    for at in range(0, len(y) if len(x) else 0, step):
        equal = x[None] == y[at : at + step, None]
        # Eight flags to a word: the words' sum has a count in each byte, and the product adds the bytes up.
        count = (equal.view(np.uint64).sum(2, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
        n = own_sizes[at : at + step, None]
        i, k = np.nonzero((count >= least) & (comps != own[at : at + step, None]) & (100 * np.minimum(sizes, n) >= threshold * np.maximum(sizes, n)))
        if len(i):
            est = estimate(count[i, k], own_sizes[at + i], sizes[k])
            keep = est >= low
            if g.band:  # four flags to a word: no band before this one may be equal in all of its rows
                keep[keep] = ~(equal.view(np.uint32)[i[keep], k[keep], : g.band] == 0x01010101).any(1)
            if keep.any():
                yield at + i[keep], k[keep], est[keep]


def _meet(low: float, threshold: int):
    """The members of a bucket, of one block and one block of outsiders, that take part in a pair still open: each once."""

    def run(batches):
        for groups in _groups(batches, ()):
            buckets, ids = [], []
            for g in groups:
                members, outsiders = np.zeros(len(g.left["id"]), bool), np.zeros(len(g.right["id"]), bool)
                for i, k, _ in _open_pairs(g, low, threshold):
                    outsiders[i] = members[k] = True
                found = np.union1d(g.left["id"][members], g.right["id"][outsiders])
                ids.append(found)
                buckets.append(np.full(len(found), g.bucket))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(ids))], ["bucket", "id"])

    return run


def _numbered(members: list[bytes], outsiders: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The sets as numbers of the outsiders' shingles, and how many there are; one number more stands for all other shingles."""
    x, y = ([np.frombuffer(v, np.uint64) for v in sets] for sets in (members, outsiders))
    known = np.unique(np.concatenate(y))

    def numbers(sets):
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        at[known[at] != every] = len(known)
        return np.split(at.astype(np.int32), np.cumsum([len(v) for v in sets])[:-1])

    return numbers(x), numbers(y), len(known)


def _link(low: float, threshold: int):
    """Links between components, confirmed on the full sets; a pair that links found here have connected already is passed over."""

    def run(batches):
        for groups in _groups(batches, ("set",)):
            links: list[tuple[int, int]] = []
            for g in groups:
                ids, others, numbered = g.left["id"], g.right["id"], None
                comps, own = g.left["component"].copy(), g.right["component"].copy()
                for rows, members, est in _open_pairs(g, low, threshold):
                    x, y, n = numbered = numbered or _numbered(g.left["set"], g.right["set"])
                    for i in np.unique(rows).tolist():
                        mine, at, some = np.zeros(n + 1, bool), np.flatnonzero(rows == i), 16
                        mine[y[i]] = True
                        near = members[at[np.argsort(-est[at], kind="stable")]]
                        while len(near := near[comps[near] != own[i]]):
                            now, near, some = near[:some], near[some:], min(2 * some, 512)
                            sizes = np.array([len(x[k]) for k in now])
                            shared = np.add.reduceat(mine[np.concatenate([x[k] for k in now])], np.cumsum(sizes) - sizes, dtype=np.int64)
                            for k in now[100 * shared >= threshold * (len(y[i]) + sizes - shared)].tolist():
                                if comps[k] != own[i]:
                                    links.append((int(ids[k]), int(others[i])))
                                    old, new = own[i], comps[k]
                                    comps[comps == old] = new
                                    own[own == old] = new
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of a bucket and its blocks together and in order."""
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")


def bucket_sizes(known: DataFrame) -> DataFrame:
    """known: bucket, component, n. For each bucket of several components: its largest one (main), members and shingles in all and outside of it."""
    counts = known.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("rows", "shingles", "component")).alias("m")
    sizes = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("rows").alias("n_all"), F.sum("shingles").alias("s_all"), largest).where("parts > 1")
    return stored(sizes.select("bucket", "n_all", "s_all", F.expr("n_all - m.rows").alias("n_out"), F.expr("s_all - m.shingles").alias("s_out"), F.col("m.component").alias("main")), "open-buckets")


def comparisons(sizes: DataFrame) -> int:
    """Pairs of a member and an outsider that the buckets above BLOCK need compared."""
    return sizes.where(F.col("n_all") > BLOCK).agg(F.sum(F.col("n_all") * F.col("n_out"))).first()[0] or 0


def _blocked(rows: DataFrame, sizes: DataFrame, most: int, shingles: int | None = None) -> DataFrame:
    """Members of a bucket (side 0) against its outsiders (side 1), both cut into blocks: a row for each block it is compared in.

    A block has about so many rows at most and, if given, so many shingles. rows: bucket, band, id, n, component; sizes: of the same rows.
    """
    rows = rows.join(sizes, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    blocks = lambda n, s: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(s) / shingles)) if shingles else F.ceil(F.col(n) / most)
    members, outsiders = blocks("n_all", "s_all"), blocks("n_out", "s_out")
    zero = F.lit(0).cast("long")
    left = rows.withColumn("side", F.lit(0)).withColumn("i", F.pmod(F.xxhash64("id"), members)).withColumn("j", F.explode(F.sequence(zero, outsiders - 1)))
    right = rows.where("outside").withColumn("side", F.lit(1)).withColumn("i", F.explode(F.sequence(zero, members - 1))).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), outsiders))
    return left.unionByName(right).drop("n_all", "n_out", "s_all", "s_out", "main", "outside")


def _verified(star: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links among the candidates (a, b): each b's best a's by estimate, confirmed on the full sets."""
    est = with_registers(star.distinct(), classes).mapInArrow(_estimates(least_estimate(threshold)), "a long, b long, est double")
    # A class has as many candidates as bands at most.
    best = est.groupBy("b").agg(F.array_sort(F.collect_list(F.struct((-F.col("est")).alias("e"), "a"))).alias("c"))
    best = stored(best.select("b", F.explode(F.slice("c", 1, BEST)).alias("c")).select("c.a", "b"), "best")
    return stored(confirmed(best, docs, classes, k, threshold), "links")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return stored(connected_components(stored(edges, "all-links")), "components")


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    of = parts.select(F.col("node").alias("id"), "component")
    return stored(members.join(of, "id", "left").withColumn("component", F.coalesce("component", "id")), "bucket-members")


def near_components(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns a row for each: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    rows = docs.select("doc_id", "text")
    sketches = stored(rows.mapInArrow(_sketch(k), f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, digest binary, registers binary"), "sketches")
    some = sketches.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # Hubs: the smallest id of each bucket. They are written, so that the join may split the members of a hot bucket.
    banded = stored(classes.select("id", "n", "registers").mapInArrow(_bands, "bucket long, band int, id long, n long"), "bands")
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = stored(hubs.select("bucket", "hub"), "hubs")
    members = stored(banded.join(hubs, "bucket"), "members")
    star = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    parts = stored(connected_components(_verified(star, docs, classes, k, threshold)), "components")

    known = _placed(members.drop("hub"), parts)
    sizes = bucket_sizes(known)
    need = comparisons(sizes)
    while need > ROUND_BLOCKS * BLOCK**2:
        large = known.join(sizes.where(F.col("n_all") > BLOCK).select("bucket"), "bucket", "left_semi")
        stands = hubs.join(parts.select(F.col("node").alias("hub"), "component"), "hub", "left").select("bucket", F.coalesce("component", "hub").alias("component"))
        further = large.join(stands.distinct(), ["bucket", "component"], "left_anti").groupBy("bucket").agg(F.min(F.struct("id", "component")).alias("h"))
        further = stored(further.select("bucket", F.col("h.id").alias("hub"), F.col("h.component").alias("own")), "further-hubs")
        star = large.join(further, "bucket").where("component <> own").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        links = _verified(star, docs, classes, k, threshold)
        if not links.limit(1).count():
            break
        parts, hubs = _joined(parts, links), hubs.unionByName(further.select("bucket", "hub"))
        known = _placed(known.join(sizes.select("bucket"), "bucket", "left_semi").drop("component"), parts)
        sizes = bucket_sizes(known)
        before, need = need, comparisons(sizes)
        if 2 * need > before:
            break

    # What is left: first which members have an open pair at all, by their registers alone, then the sets of those.
    sketch, low = classes.select("id", "registers"), least_estimate(threshold)
    met = _dealt(_blocked(known, sizes, BLOCK).join(sketch, "id")).mapInArrow(_meet(low, threshold), "bucket long, id long")
    met = stored(met.distinct(), "open-members")
    if met.limit(1).count():
        sets = stored(full_sets(docs, classes, met.select("id").distinct(), k).dropDuplicates(["id"]), "open-sets")
        still = stored(known.join(met, ["bucket", "id"], "left_semi"), "open-known")
        still = _blocked(still, bucket_sizes(still), BLOCK, BLOCK_SHINGLES)
        parts = _joined(parts, _dealt(still.join(sketch, "id").join(sets, "id")).mapInArrow(_link(low, threshold), "a long, b long"))

    of = parts.select(F.col("node").alias("id"), "component")
    placed = classes.select("id", "digest", "first_doc").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = stored(placed.groupBy("component").agg(F.min("first_doc").alias("component_id")), "component-ids")
    placed = placed.join(smallest, "component").select("digest", "component_id")
    out = sketches.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a, b = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "registers_a", "registers_b")


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """Of each component the document with the smallest doc_id (null last), then text digest, all columns; rows that repeat it whole stay."""
    found = near_components(keyed(docs), k, threshold)
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id.doc_id", "doc_id.digest").distinct()
    return by_keys(docs, gone, "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 1), ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
