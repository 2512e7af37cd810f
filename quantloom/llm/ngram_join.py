"""Near-duplicate documents by an exact set-similarity join on parity sketches.

A document's set holds its distinct k-word shingles as 64-bit hashes. Its parity
sketch is cut into blocks by the leading bits of the hashes; a block's word is the
XOR of the hashes in it. An element in one set only changes one block, so two
sketches differ in at most as many blocks as the symmetric difference has
elements, and at similarity s that is at most (1 - s) / (1 + s) * (|A| + |B|).

Pigeonhole: with at most D differing blocks, the D + 1 first blocks of each
document in any order common to all documents have one (block, word) in common.
The order puts words that hold only widespread shingles last, so a passage that
many documents share seldom makes candidates. Sizes fall into bands of a factor
of four with a layout of their own; a document just above a band also joins in
the layout below.

Candidates are never all pairs of a bucket. A bucket links its members to its
smallest one (first within a batch, so that a word shared by very many rows
reaches the shuffle once a batch), the links are verified on the full sets, and
only members of buckets that are still apart are compared further, in blocks of
bounded size, filtered by a small parity bitmap before the sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import bloom, components, cut, few, passes, small_batches, spots
from .textkit import as_long, mix, shingle_sets, table, texts

_U = np.uint64
BAND = 4
WIDESPREAD = 1 << 17  # shingles kept in the order's table: a proven bound on what is broadcast
BLOCK = 512  # members of a bucket that one task compares with as many others
BLOCK_BYTES = 4 << 20  # of their shingles


def _band(n: int) -> int:
    b = 0
    while BAND**b < n:
        b += 1
    return b


def _blocks_log2(band: int) -> int:
    """log2 of the layout's number of blocks: half the largest size in the band, 64 at least."""
    return max(6, 2 * band - 1)


class Order:
    """The order of block words: how widespread the rarest shingle in the block is, then the hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.hashes, self.weights = hashes, weights
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hashes & _U((1 << 22) - 1)] = True

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint8)
        if len(self.hashes):
            hit = np.flatnonzero(self.maybe[x & _U((1 << 22) - 1)])
            if len(hit):
                at = np.minimum(np.searchsorted(self.hashes, x[hit]), len(self.hashes) - 1)
                out[hit] = np.where(self.hashes[at] == x[hit], self.weights[at], 0)
        return out


def prefix(a: np.ndarray, weights: np.ndarray, band: int, distance: int) -> np.ndarray:
    """The ``distance`` + 1 first (block, word) keys of a sorted set in a band's layout."""
    log2 = _blocks_log2(band)
    block = a >> _U(64 - log2)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    word = np.bitwise_xor.reduceat(a, edge)
    seen = block[edge]
    weight = np.minimum.reduceat(weights, edge).astype(_U)
    key = mix(word + mix(seen * _U(64) + _U(band)))
    rank = (weight << _U(58)) | (key >> _U(6))
    need = distance + 1
    if len(rank) > need:
        return np.partition(rank, need - 1)[:need]
    if len(rank) < need:  # then empty blocks count too; they come last, by place
        empty = np.setdiff1d(np.arange(1 << log2, dtype=_U), seen)[: need - len(rank)]
        rank = np.concatenate([rank, (_U(63) << _U(58)) | (mix(mix(empty * _U(64) + _U(band))) >> _U(6))])
    return rank


def signatures(a: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
    """All join keys of one set. ``percent``: the similarity, as a whole number of hundredths."""
    n = len(a)
    band = _band(n)
    # |A ^ B| * (100 + p) <= (100 - p) * (|A| + |B|), and |B| <= 100 |A| / p
    own = ((100 - percent) * (n * percent + n * 100)) // (percent * (100 + percent))
    keys = [prefix(a, weights, band, own)]
    if band and n * percent <= 100 * BAND ** (band - 1):
        keys.append(prefix(a, weights, band - 1, ((100 - percent) * (BAND ** (band - 1) + n)) // (100 + percent)))
    return np.concatenate(keys)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, bounds) for slices of (id, text, ...) batches."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for t in texts(b.column(1)):
            hashes, bounds = shingle_sets(t, k)
            yield ids[t.first : t.first + t.n], hashes, bounds


def _sliced(b: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(b), rows):
        yield b.slice(at, rows)


def widespread(docs: DataFrame, k: int) -> Order:
    """The shingles in most documents, among those that come twice in the documents of some batch.

    It decides an order only; results do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            x = np.sort(np.concatenate(parts))
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
            n = np.diff(np.append(edge, len(x)))
            return table(schema, h=as_long(x[edge][n > 1]), n=n[n > 1])

        parts: list[np.ndarray] = []
        held, seen = 0, set()
        for _, hashes, bounds in _sets(batches, k):
            for i in range(len(bounds) - 1):
                a = hashes[bounds[i] : bounds[i + 1]]
                if len(a) and (mark := (int(np.bitwise_xor.reduce(a)), len(a))) not in seen:  # a copy tells nothing new
                    seen.add(mark)
                    parts.append(a)
                    held += len(a)
            if held > 2_000_000:
                yield from _sliced(flush(parts))
                parts, held, seen = [], 0, set()
        if parts:
            yield from _sliced(flush(parts))

    found = docs.select("id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    found = cut(found.select("h", F.least(F.lit(62), (1 + 2 * F.log2("n")).cast("int")).alias("w")))
    # whole weights from the top, as many as fit; there are 62 at most
    level, total = 63, 0
    for r in found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("w")).collect():
        total += r.n
        if total > WIDESPREAD:
            break
        level = r.w
    rows = found.where(F.col("w") >= level).toPandas()
    h, w = rows["h"].to_numpy(np.int64).view(_U), rows["w"].to_numpy(np.uint8)
    at = np.argsort(h)
    return Order(h[at], w[at])


#: kind 0: a bucket's member (rep 1: others of its batch were left out); 1: a link (rep, doc) in bucket key;
#: 2: a document's set size in key; 3: a link of a bucket of two; 4: equal sets.
_ROW = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("rep", pa.int64()), ("doc", pa.int64())])
_ROW_SQL = "kind byte, key long, rep long, doc long"


def _gather(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and documents, and of each row the smallest document with its key."""
    at = np.lexsort((doc, key)) if len(key) < 1 << 16 else np.argsort(key, kind="stable")
    key, doc = key[at], doc[at]
    if not len(key):
        return key, doc, doc
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low = np.minimum.reduceat(doc, edge)
    return key, doc, np.repeat(low, np.diff(np.append(edge, len(key))))


def _emit(batches: Iterator[pa.RecordBatch], k: int, percent: int, order: Order) -> Iterator[pa.RecordBatch]:
    def flush(keys: list, docs: list) -> pa.RecordBatch:
        key, doc, low = _gather(np.concatenate(keys), np.concatenate(docs))
        twice = np.zeros(len(key), bool)
        twice[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        link = (low != doc) & ~twice
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        crowd = np.add.reduceat(link, edge) > 0
        return table(
            _ROW,
            kind=np.concatenate([np.zeros(len(edge), np.int8), np.ones(link.sum(), np.int8)]),
            key=np.concatenate([key[edge], key[link]]),
            rep=np.concatenate([crowd.astype(np.int64), low[link]]),
            doc=np.concatenate([low[edge], doc[link]]),
        )

    keys: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    held = 0
    first: dict[bytes, int] = {}  # sets of this batch, by digest
    for ids, hashes, bounds in _sets(batches, k):
        weights = order.of(hashes)
        sizes = np.diff(bounds)
        same: list[tuple[int, int]] = []
        for i in np.flatnonzero(sizes):
            a = hashes[bounds[i] : bounds[i + 1]]
            one = first.setdefault(blake2b(a.tobytes(), digest_size=16).digest(), int(ids[i]))
            if one != ids[i]:
                same.append((one, int(ids[i])))
                continue
            x = as_long(signatures(a, weights[bounds[i] : bounds[i + 1]], percent))
            keys.append(x)
            docs.append(np.full(len(x), ids[i]))
            held += len(x)
        pairs = np.array(same, np.int64).reshape(-1, 2)
        yield table(
            _ROW,
            kind=np.concatenate([np.full(len(ids), 2, np.int8), np.full(len(pairs), 4, np.int8)]),
            key=np.concatenate([sizes, np.zeros(len(pairs), np.int64)]),
            rep=np.concatenate([np.zeros(len(ids), np.int64), pairs[:, 0]]),
            doc=np.concatenate([ids, pairs[:, 1]]),
        )
        if held > 1_000_000:
            yield from _sliced(flush(keys, docs))
            keys, docs, held, first = [], [], 0, {}
    if keys:
        yield from _sliced(flush(keys, docs))


def _bucket_links(key: np.ndarray, crowd: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, smallest, doc, many) of whole buckets, one row for each member but the smallest."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key)))
    low = np.repeat(np.minimum.reduceat(doc, edge), count)
    many = np.repeat((count > 2) | (np.add.reduceat(crowd, edge) > 0), count)
    link = low != doc
    return key[link], low[link], doc[link], many[link]


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of equal keys become links to the smallest; other rows pass. Rows come in the order of keys.

    Buckets of two are done with their one link. Only the bucket that is open is
    held, with one row for each batch of documents that has its key.
    """
    held: list[tuple] = []
    twos: list[tuple[np.ndarray, np.ndarray]] = []
    n_twos = 0

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal n_twos
        key, low, doc, many = _bucket_links(*rows)
        twos.append((low[~many], doc[~many]))
        n_twos += len(twos[-1][0])
        yield table(_ROW, kind=np.ones(many.sum(), np.int8), key=key[many], rep=low[many], doc=doc[many])

    def pairs() -> pa.RecordBatch:
        low, doc = np.unique(np.stack([np.concatenate(c) for c in zip(*twos)]), axis=1)
        return table(_ROW, kind=np.full(len(low), 3, np.int8), key=np.zeros(len(low), np.int64), rep=low, doc=doc)

    for b in batches:
        pick = b.column(0).to_numpy() == 0
        if not pick.all():
            yield b.filter(pa.array(~pick))
        rows = [b.column(j).to_numpy()[pick] for j in (1, 2, 3)]
        if not len(rows[0]):
            continue
        if held and held[-1][0][-1] == rows[0][0] == rows[0][-1]:
            held.append(rows)  # all of it belongs to the open bucket
            continue
        rows = [np.concatenate(c) for c in zip(*held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [[c[last:] for c in rows]]
        if last:
            yield from links([c[:last] for c in rows])
        if n_twos > 500_000:
            yield pairs()
            twos, n_twos = [], 0
    if held:
        yield from links([np.concatenate(c) for c in zip(*held)])
    if n_twos:
        yield pairs()


def _bitmap_bits(n: int) -> int:
    return min(1 << 15, max(512, 1 << int(2 * n - 1).bit_length()))


def bitmap(a: np.ndarray) -> bytes:
    """Parities of the numbers of hashes with equal trailing bits, a power of two of them."""
    bits = _bitmap_bits(len(a))
    return np.packbits((np.bincount((a & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def maybe_linked(n1: int, s1: bytes, n2: int, s2: bytes, percent: int) -> bool:
    """False only for pairs that sizes or parity bitmaps prove apart."""
    if min(n1, n2) * 100 < percent * max(n1, n2):
        return False
    x, y = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
    return differ * (100 + percent) <= (100 - percent) * (n1 + n2)


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """The definition, on two sorted sets: 100 * |A & B| >= percent * |A | B|."""
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return bool(len(a)) and 100 * common >= percent * (len(a) + len(b) - common)


def _candidate_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, bitmap, elements) of the documents among ids, and of a few others.

    Ids go to all tasks as a filter sized by their number; beyond ``BLOOM_IDS`` they
    are joined.
    """
    n = ids.count()
    filt = docs.sparkSession.sparkContext.broadcast(bloom(ids, n)) if n <= shared.BLOOM_IDS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("elements", pa.binary())])
        for b in batches:
            if filt:
                b = b.filter(pa.array(passes(filt.value, [b.column(2 + j).to_numpy() for j in range(3)])))
            for own, hashes, bounds in _sets(iter([b]), k):
                sets = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(own))]
                yield table(schema, id=own, n=np.diff(bounds), bits=[bitmap(a) for a in sets], elements=[a.tobytes() for a in sets])

    hashed = docs.select("id", "text", *[s.alias(f"p{i}") for i, s in enumerate(spots(F.col("id")))])
    hashed = hashed if filt else hashed.join(ids, "id", "leftsemi")
    return hashed.mapInArrow(run, "id long, n long, bits binary, elements binary")


def _pairs_that(pairs: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The pairs (a, b) that pass the bitmap filter, or with ``whole`` the definition itself."""
    cols = ["elements"] if whole else ["n", "bits"]
    left = sets.select(F.col("id").alias("b"), *[F.col(c).alias(c + "_b") for c in cols])
    right = sets.select(F.col("id").alias("a"), *[F.col(c).alias(c + "_a") for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                t = b.slice(at, 256)
                c = [x.to_pylist() for x in t.columns[2:]]
                if whole:
                    keep = [linked(x, y, percent) for x, y in zip(*c)]
                else:
                    keep = [maybe_linked(n1, s1, n2, s2, percent) for n1, s1, n2, s2 in zip(*c)]
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    want = ["a", "b", *[f"{c}_b" for c in cols], *[f"{c}_a" for c in cols]]
    # where pairs are few, only the sets they name are shuffled, and not all sets
    left = left.join(few(pairs), "b")
    right = right.join(few(pairs.select("a").distinct()), "a")
    return left.join(right, "a").select(*want).mapInArrow(run, "a long, b long")


def _labelled(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs with the components ca and cb of their ends (the ends themselves where they have none)."""
    for c in ("a", "b"):
        named = comp.select(F.col("node").alias(c), F.col("component").alias("c" + c))
        pairs = pairs.join(named, c, "left").withColumn("c" + c, F.coalesce("c" + c, c))
    return pairs


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components that further links leave: only components that those connect are looked at again."""
    between = cut(_labelled(links, comp).where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return comp
    more = cut(components(between))
    known = comp.join(more.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    known = known.select("node", F.coalesce("new", "component").alias("component"))
    return cut(known.unionByName(more.join(comp, "node", "leftanti")))


def _open_members(rows: DataFrame, tested: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id) of buckets of three or more with a link that failed."""
    failed = cut(_labelled(tested, comp).where("ca != cb").select(F.col("a").alias("rep"), F.col("b").alias("doc")))
    keys = cut(rows.join(few(failed), ["rep", "doc"], "leftsemi").select("key").distinct())
    links = rows.join(few(keys), "key", "leftsemi")
    return cut(links.select("key", F.explode(F.array("doc", "rep")).alias("id")).distinct())


def _central(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of a bucket's members with its most connected one: the one in most such buckets.

    Copies with random changes are closest to what they were copied from, and that
    one shares the most words with the others. One pair a member, of different
    components only.
    """
    degree = members.groupBy("id").agg(F.count("*").alias("d"))
    known = members.join(degree, "id")
    centre = known.groupBy("key").agg(F.max_by("id", F.struct("d", -F.col("id"))).alias("c"))
    pairs = members.join(centre, "key").where("id != c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    return _labelled(pairs, comp).where("ca != cb").select("a", "b")


def _hopeful(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a cell, the later rows of another component that sizes and bitmaps do not prove apart.

    Labels of components may be changed in the array that comes along, between rows.
    """
    ids, comps, chunk, within = (t[c].to_numpy() for c in ("id", "component", "chunk", "within"))
    n, bits = t["n"].to_numpy(), t["bits"].to_pylist()
    labels = comps.copy()
    size = min((len(x) for x in bits), default=0)
    maps = np.stack([_folded(np.frombuffer(x, np.uint8), size) for x in bits]) if len(bits) else np.zeros((0, 0), np.uint8)
    maps = np.ascontiguousarray(maps).view(_U)
    for i in range(len(ids)):
        ok = (labels != labels[i]) & (ids > ids[i]) & (within | (chunk != chunk[i]))
        ok &= np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i])
        j = np.flatnonzero(ok)
        if len(j):
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1).astype(np.int64)
            near = differ * (100 + percent) <= (100 - percent) * (n[j] + n[i])
            j = j[near][np.argsort(differ[near], kind="stable")]
            if len(j):
                yield i, j, labels


def _apart(members: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Verified links between bucket members that no link joins yet.

    Buckets in question have three members or more and a link that failed. Their
    members are compared in cells of two blocks, each cell a group of its own, so the
    largest bucket is still many small groups; a block has at most ``BLOCK`` members
    and about ``BLOCK_BYTES`` of shingles. Bitmaps come first. Only members with a hopeful
    partner are joined with their sets and verified, within the cell, where a link makes
    one component of two; so a cell gives fewer links than it has members, not all pairs.
    """
    # buckets with the same members are one
    members = members.join(sets.select("id", "n"), "id")
    alike = members.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.count("*").alias("m"), F.max("n").alias("largest"))
    alike = alike.groupBy("x", "m").agg(F.min("key").alias("key"), F.max("largest").alias("largest"))
    members = members.join(alike.select("key", "m", "largest"), "key")
    # a bucket whose members are of one component is done
    named = comp.select(F.col("node").alias("id"), "component")
    members = cut(members.join(named, "id", "left").withColumn("component", F.coalesce("component", "id")))
    split = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    members = members.join(few(cut(split)), "key", "leftsemi")
    # a bucket larger than a block is dealt into chunks by a hash of the member
    block = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("largest")))))
    members = members.withColumn("chunks", F.ceil(F.col("m") / block).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
    spread = members.select(
        "id", "component", "key", "chunk",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"),
    ).select(
        "id", "component", "chunk",
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"),
        (F.col("chunk") == F.col("other")).alias("within"),
    )
    cells = spread.join(sets.select("id", "n", "bits"), "id")

    def partners(t: pa.Table) -> pa.Table:
        some = np.zeros(len(t), bool)
        for i, j, _ in _hopeful(t, percent):
            some[i] = True
            some[j] = True
        return t.select(["id", "component", "chunk", "cell", "within"]).filter(pa.array(some))

    def verify(t: pa.Table) -> pa.Table:
        ids, elements = t["id"].to_numpy(), t["elements"]
        a, b = [], []
        for i, js, labels in _hopeful(t, percent):
            own = elements[i].as_py()
            for j in js.tolist():
                if labels[j] != labels[i] and linked(own, elements[j].as_py(), percent):
                    labels[labels == labels[j]] = labels[i]
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    some = cut(cells.groupBy("cell").applyInArrow(partners, "id long, component long, chunk int, cell long, within boolean"))
    own = sets.join(few(some.select("id").distinct()), "id", "leftsemi")  # only the sets that are looked at are shuffled
    return some.join(own, "id").groupBy("cell").applyInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_verified.

    ``component_id`` is the smallest id that links (similarity of at least
    ``percent`` hundredths) reach. ``n_verified`` counts the links that were verified
    at this document and carry the component; within one component further pairs
    may link that nothing depends on, so it is a lower bound of the number of links. Null or wordless texts: size 0, linked with nothing. A null id
    keeps its row, takes no part in links and has a null component. Rows with one
    id are one node: what either links to, the id links to. Other columns are
    ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = own.where("id is not null")
    order = widespread(named, k)
    spread = named.sparkSession.sparkContext.broadcast((order.hashes, order.weights))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(batches, k, percent, Order(*spread.value))

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = named.mapInArrow(emit, _ROW_SQL)
    dealt = dealt.repartition(parts, F.when(F.col("kind") == 0, F.col("key")).otherwise(F.xxhash64("doc", "key"))).sortWithinPartitions("key")
    rows = cut(dealt.mapInArrow(_group, _ROW_SQL))
    sizes = rows.where("kind = 2").select(F.col("doc").alias("id"), F.col("key").alias("n_shingles"))
    known = rows.where("kind = 4").select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b"))
    # one pair of documents may meet in many buckets
    pairs = cut(rows.where("kind in (1, 3)").select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct())
    rows = rows.where("kind = 1").select("key", "rep", "doc")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = cut(_candidate_sets(named, ids, k))
    hopeful = cut(_pairs_that(pairs, sets, percent, whole=False))
    links = cut(_pairs_that(hopeful, sets, percent, whole=True)).unionByName(known)
    comp = cut(components(links))
    tested = pairs.select("a", "b")
    members = _open_members(rows, tested, comp)
    central = cut(_central(members, comp).join(tested, ["a", "b"], "leftanti"))
    likely = cut(_pairs_that(central, sets, percent, whole=False))
    more = cut(_pairs_that(likely, sets, percent, whole=True))
    links, comp = links.unionByName(more), _merged(comp, more)
    last = cut(_apart(members, sets, comp, percent))
    links, comp = links.unionByName(last), _merged(comp, last)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_verified"))
    out = sizes.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").join(degree, "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    nameless = own.where("id is null")

    def only_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_shingles", pa.int64())])
        for _, _, bounds in _sets(batches, k):
            yield table(schema, n_shingles=np.diff(bounds))

    nameless = nameless.mapInArrow(only_sizes, "n_shingles long").select(
        F.lit(None).cast("long").alias("id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_verified")
    )
    return out.unionByName(nameless).withColumnRenamed("id", id_col)
