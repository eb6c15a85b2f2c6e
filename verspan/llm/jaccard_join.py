"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes (64 bits) of its distinct k-word shingles. Two sets
link when ``percent`` or more of their union is shared; connected documents form a
class. The steps:

1. One pass gives each document its set's size, digest, min-hashes and a parity bitmap,
   and counts shingles that repeat within a window of a task: frequent ones come last in
   the global order, which keeps index lists short. Equal sets are one set from here on:
   its answers are the answers of all its copies.
2. Sets that share min-hashes gather around a leader, the one with the smallest digest.
   A member is kept as its difference to the leader's set. Which sets have a leader is a
   matter of speed only; a set without one leads itself alone.
3. Each set puts its prefix, the first ``n - ceil(percent * n / 100) + 1`` shingles in
   the order, into an inverted index, under its leader's name: a leader stands in a list
   once, with the smallest and largest size and the most room (members from the shingle's
   position on) among its own. Lists are ordered by size and read in blocks; blocks whose
   sizes are too far off or whose positions leave too little room are skipped whole, then
   single pairs of leaders by the same rules and by their bitmaps.
4. The sets of two leaders that meet are compared once: that difference makes the members
   of the smaller cluster answers of the larger one, as differences to its leader. The
   answers of each member are then derived from its leader's: two sets differ in their
   differences' symmetric difference, so only the few shingles in which a member departs
   from its leader are looked at. No pairs leave a cluster: each set's links are counted
   where they are found, and one edge for each set tells what it is connected with.
   A cluster with very many answers is dealt to tiles of ``TILE`` sets.
5. Components of those edges by large and small stars.

Every pair of different sets that links is verified and counted. A cluster of G different
sets costs G * G / TILE rows in its tiles; copies cost nothing.

Defined cases: a text with fewer than k words is one shingle, its whole sequence; a
null text or one without words has an empty set that links with nothing, not even
with another empty one. Documents that share an id each keep their row and are of one
class, as the class is the id's. A document without an id keeps its row, takes part in
no link and has a null class. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import components, hashed, mixed, multipliers, ngrams, packed, partitions, scratch, signed, small_batches, stored, table, texts, tidy, unpacked, words

#: Most shingles that count as frequent; 8 bytes each are sent to all workers.
MAX_FREQUENT = 1 << 17
#: Shingles of a window, and how often one has to occur in it to be reported.
WINDOW, WINDOW_MIN = 1_000_000, 4
#: Postings that a task gathers before it sends its blobs, and those of a bucket of the index.
FLUSH, BUCKET = 200_000, 150_000
BITMAP_WORDS = 4
#: Bits of the bitmaps that pairs of leaders are checked with before their sets are brought together.
WIDE_BITS = 4096
#: Min-hashes of a set, and how many of them a set shares with its leader.
MINHASHES, SHARED = 8, 4
#: Entries of a block of an index list.
LIST_BLOCK = 64
#: Lists longer than this are read by blocks.
LONG_LIST = 96
#: Answers and bytes of differences that one tile of a cluster holds.
TILE, TILE_BYTES = 4096, 32 << 20
#: Most ids (16 bytes each) that are broadcast to find their texts; beyond it texts are shuffled by id.
MAX_BROADCAST_IDS = 1_000_000
#: Rows of a batch, of texts, whole sets or blobs.
BATCH_ROWS = 128

_SALTS = mixed(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_HASHES = [f"m{i}" for i in range(MINHASHES)]
_BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    ws = words(text) if text else []
    if not ws:
        return np.empty(0, np.uint64)
    w = hashed(ws)
    if len(w) < k:
        return mixed(np.array([(w * multipliers(len(w))).sum(dtype=np.uint64) + np.uint64(len(w))]))
    return np.unique(ngrams(w, k))


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def minhashes(s: np.ndarray) -> np.ndarray:
    return np.array([(s * x).min() for x in _SALTS], np.uint64) if len(s) else np.zeros(MINHASHES, np.uint64)


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the set's members by slots: two bitmaps differ in no more bits than the sets do in members."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _signatures(k: int):
    """Rows of kind 0: document id, set size, digest, min-hashes, bitmap; of kind 1: frequent shingle, occurrences."""
    names = ["kind", "a", "n", "sid", *_HASHES, *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = [], 0

        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(window), return_counts=True)
            v, c = v[c >= WINDOW_MIN], c[c >= WINDOW_MIN]
            zero = pa.array(np.zeros(len(v), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), np.int32)), signed(v), pa.array(c.astype(np.int64)), *[zero] * (len(names) - 3)], names)

        for b in batches:
            n, d, more = [], [], np.zeros((b.num_rows, MINHASHES + BITMAP_WORDS), np.uint64)
            for i, t in enumerate(texts(b.column("text"))):
                s = shingle_set(t, k)
                n.append(len(s))
                d.append(digest(s))
                if len(s):
                    more[i, :MINHASHES], more[i, MINHASHES:] = minhashes(s), _bitmap(s, 64 * BITMAP_WORDS)
                window.append(s)
                held += len(s)
                if held >= WINDOW:
                    yield counted()
                    window, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()),
                                              *(signed(np.ascontiguousarray(c)) for c in more.T)], names)
        if held:
            yield counted()
    return run


def ordered(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, the frequent ones after all others, the most frequent last."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hot = frequent[at] == s
    return s if not hot.any() else np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _least_overlap(n, percent: int):
    """Least intersection of two sets with n members together: 100 i >= percent (n - i)."""
    return (percent * n + 99 + percent) // (100 + percent)


def _most_apart(n, percent: int):
    """No two sets with n members together, or fewer, link when they differ in more members than this."""
    return n * (100 - percent) // (100 + percent)


def _summed(key: np.ndarray, tok, who, room, low, high):
    """One posting for each (key, shingle, leader): the most room, the smallest and largest size."""
    by = np.lexsort((who, tok, key))
    key, tok, who = key[by], tok[by], who[by]
    first = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (who[1:] != who[:-1]) | (key[1:] != key[:-1])])
    return key[first], tok[first], who[first], np.maximum.reduceat(room[by], first), np.minimum.reduceat(low[by], first), np.maximum.reduceat(high[by], first)


def _index(k: int, percent: int, buckets: int, frequent_b):
    """Blobs of postings by bucket; info of a leader: its digest, its farthest member's distance, its bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = frequent_b.value
        toks, rooms, sizes, whos, infos, number, held = [], [], [], [], [], {}, 0

        def flushed() -> pa.RecordBatch:
            each = [len(t) for t in toks]
            tok, room, n = np.concatenate(toks), np.concatenate(rooms), np.repeat(np.array(sizes, np.int64), each)
            to = (mixed(tok) % np.uint64(buckets)).astype(np.int64)
            to, tok, who, room, low, high = _summed(to, tok, np.repeat(np.array(whos, np.int64), each), room, n, n)
            info = np.array(infos, np.uint64)
            edges = np.searchsorted(to, np.arange(buckets + 1))
            bs, blobs = [], []
            for i in np.flatnonzero(np.diff(edges)).tolist():
                x = slice(edges[i], edges[i + 1])
                own, at = np.unique(who[x], return_inverse=True)
                head = np.array([x.stop - x.start, len(own)], np.uint64).tobytes()
                rest = np.concatenate([at, room[x], low[x], high[x] - low[x]]).astype(np.uint32)
                blobs.append(head + packed(tok[x]) + rest.view(np.uint8).reshape(-1, 4).T.tobytes() + info[own].tobytes())  # byte plane by byte plane
                bs.append(i)
            return pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            for t, sid, *info in zip(texts(b.column("text")), *(b.column(c).to_pylist() for c in ("sid", "leader", "radius", *_BITS))):
                s = shingle_set(t, k)
                if digest(s) != sid:  # another text with the same id
                    continue
                if info[0] not in number:
                    number[info[0]] = len(infos)
                    infos.append([x % (1 << 64) for x in info])
                p = ordered(s, frequent, rank)[: prefix_length(len(s), percent)]
                toks.append(p)
                rooms.append(len(s) - np.arange(len(p)))
                sizes.append(len(s))
                whos.append(number[info[0]])
                held += len(p)
                if held >= FLUSH:
                    yield flushed()
                    toks, rooms, sizes, whos, infos, number, held = [], [], [], [], [], {}, 0
        if held:
            yield flushed()
    return run


def list_pairs(tok, low, high, room, radius, bits, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of lists ordered by (shingle, smallest size) that no filter can rule out."""
    def passed(a, b):
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        ok &= np.minimum(room[a], room[b]) >= _least_overlap(low[a] + low[b], percent)
        a, b = a[ok], b[ok]
        far = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        ok = far <= _most_apart(high[a] + high[b], percent) + radius[a] + radius[b]
        return a[ok], b[ok]

    n = len(tok)
    start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if n else np.empty(0, np.int64)
    length = np.diff(np.r_[start, n])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # short lists: all lists at once, one distance within the list after the other
    end = np.repeat(start + length, length)
    alive = np.flatnonzero(np.repeat((length > 1) & (length <= LONG_LIST), length))
    d = 1
    while len(alive):
        alive = alive[alive + d < end[alive]]
        alive = alive[100 * high[alive] >= percent * low[alive + d]]  # the smallest size only grows along a list
        a, b = passed(alive, alive + d)
        left.append(a)
        right.append(b)
        d += 1
    # long lists: blocks are skipped by sizes and by positions
    for s, m in zip(start[length > LONG_LIST].tolist(), length[length > LONG_LIST].tolist()):
        cut = np.arange(s, s + m, LIST_BLOCK)
        least, most, free = (f.reduceat(x[s : s + m], cut - s) for f, x in ((np.minimum, low), (np.maximum, high), (np.maximum, room)))
        for a in range(s, s + m):
            open_ = (100 * high[a] >= percent * least) & (100 * most >= percent * low[a]) & (np.minimum(free, room[a]) >= _least_overlap(low[a] + least, percent)) & (cut + LIST_BLOCK > a + 1)
            b = (cut[open_][:, None] + np.arange(LIST_BLOCK)).ravel()
            a_, b_ = passed(np.full(len(b := b[(b > a) & (b < s + m)]), a), b)
            left.append(a_)
            right.append(b_)
    return np.concatenate(left), np.concatenate(right)


def _pairs(percent: int):
    """Pairs of leaders u < v that meet in a bucket's index lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for i, x in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                by.setdefault(i, []).append(x)
        while by:
            toks, postings, infos, shift = [], [], [], 0
            for x in by.pop(next(iter(by))):
                n, m = np.frombuffer(x, np.uint64, 2).astype(np.int64)
                toks.append(unpacked(x[16 : 16 + 8 * n]))
                planes = np.frombuffer(x, np.uint8, 16 * n, 16 + 8 * n).reshape(4, -1)
                postings.append(np.ascontiguousarray(planes.T).view(np.uint32).reshape(4, -1).astype(np.int64))
                postings[-1][0] += shift
                postings[-1][3] += postings[-1][2]
                infos.append(np.frombuffer(x, np.uint64, m * (2 + BITMAP_WORDS), 16 + 24 * n).reshape(m, -1))
                shift += m
            info = np.concatenate(infos)
            _, first, code = np.unique(info[:, 0], return_index=True, return_inverse=True)  # leaders that several tasks sent
            info = info[first]
            who, room, low, high = np.concatenate(postings, axis=1)
            _, tok, who, room, low, high = _summed(np.zeros(len(who), np.int8), np.concatenate(toks), code[who], room, low, high)
            more = np.r_[tok[1:] == tok[:-1], False] | np.r_[False, tok[1:] == tok[:-1]]
            tok, who, room, low, high = (x[more] for x in (tok, who, room, low, high))
            sort = np.lexsort((low, tok))
            tok, who, room, low, high = (x[sort] for x in (tok, who, room, low, high))
            a, b = list_pairs(tok, low, high, room, info[who, 1].astype(np.int64), info[who, 2:], percent)
            a, b = info[who[a], 0].view(np.int64), info[who[b], 0].view(np.int64)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], ["u", "v"])
    return run


def _sets(k: int, keep: list[str], bits: int = 0):
    """The set of each row whose text has the digest asked for beside the columns kept; or its bitmap if ``bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ss = [shingle_set(t, k) for t in texts(b.column("text"))]
            body = pa.array([(_bitmap(s, bits) if bits else s).tobytes() for s in ss], pa.binary())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), body], [*keep, "body"])
            yield out.filter(pa.array([digest(s) == d for s, d in zip(ss, b.column("sid").to_pylist())], pa.bool_()))
    return run


def _differences(keep: list[str]):
    """Symmetric difference of the sets in ``x`` and ``y`` beside the columns kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([len(d) for d in found], pa.int64()), pa.array([d.tobytes() for d in found], pa.binary())], [*keep, "far", "diff"])
    return run


def _near(percent: int):
    """Pairs of leaders whose bitmaps don't rule out that any of their members link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("x", "y"))
                far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield b.select(["u", "v", "most"]).filter(pa.array(far <= b.column("most").to_numpy()))
    return run


def tile_links(n, weight, own, side, diffs: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(links weighted by copies, label of its component) of each answer of one leader.

    diffs: differences to the leader. Pairs of which neither is its member (``own``) are
    another leader's matter, pairs of one ``side`` (unless all sides are equal) another tile's.
    """
    g, split = len(n), len(side) and side.min() != side.max()
    far = np.array([len(d) for d in diffs], np.int64)
    row = np.repeat(np.arange(g), far)
    _, item = np.unique(np.concatenate(diffs), return_inverse=True) if far.sum() else (None, np.empty(0, np.int64))
    count = np.bincount(item) if len(item) else np.empty(0, np.int64)
    # where most answers depart from the leader alike, the others are written down as departing
    odd = np.flatnonzero(2 * count > g)
    if len(odd):
        place = np.full(len(count), -1)
        place[odd] = np.arange(len(odd))
        has = np.zeros((len(odd), g), np.bool_)
        at = place[item] >= 0
        has[place[item[at]], row[at]] = True
        x, y = np.nonzero(~has)
        item, row = np.r_[item[~at], odd[x]], np.r_[row[~at], y]
        far = np.bincount(row, minlength=g)
    by = np.argsort(item, kind="stable")
    holders = row[by]
    first = np.searchsorted(item[by], np.arange(len(count) + 1))
    by = np.argsort(row, kind="stable")
    items, start = item[by], np.searchsorted(row[by], np.arange(g + 1))
    links, label = np.zeros(g, np.int64), np.arange(g)
    for s in range(g):
        mine = items[start[s] : start[s + 1]]
        lens = first[mine + 1] - first[mine]
        total = int(lens.sum())
        at = np.arange(total) + np.repeat(first[mine] - np.cumsum(lens) + lens, lens)
        apart = far[s] + far - 2 * np.bincount(holders[at], minlength=g)
        both = n[s] + n
        ok = (100 * (both - apart) >= percent * (both + apart)) & (own | own[s])
        if split:
            ok &= side != side[s]
        ok[s] = False
        links[s] = weight[ok].sum()
        near = np.unique(label[ok])
        if len(near) and (len(near) > 1 or near[0] != label[s]):
            near = np.union1d(near, label[s : s + 1])
            label[np.isin(label, near)] = near[0]
    return links, label


def _tiles(percent: int):
    """Links of each answer of each tile; rows come ordered by tile."""
    names = ["sid", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            sid, n, w, own, side = (np.array(c) for c in zip(*(r[:5] for r in held)))
            diffs = []
            for *_, x, y in held:
                x, y = (np.frombuffer(z or b"", np.uint64) for z in (x, y))
                diffs.append(np.setxor1d(x, y, assume_unique=True) if len(y) else x)
            links, label = tile_links(n, w, own, side, diffs, percent)
            least = np.full(len(sid), np.iinfo(np.int64).max)
            np.minimum.at(least, label, sid)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (sid, links, least[label])], names)

        for b in batches:
            for t, *r in zip(*(b.column(c).to_pylist() for c in ("tile", "sid", "n", "copies", "own", "side", "diff", "shift"))):
                if t != key and held:
                    yield done()
                    held = []
                key = t
                held.append(r)
        if held:
            yield done()
    return run


def _leaders(sets: DataFrame, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(sid, leader) of sets that share enough min-hashes with one of smaller digest that leads itself."""
    own = sets.select("sid", F.posexplode(F.array(*_HASHES)).alias("j", "m"))
    least = own.groupBy("j", "m").agg(F.min("sid").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = own.join(least, ["j", "m"]).where("sid <> leader").groupBy("sid", "leader").agg(F.count("*").alias("c"))
    shared = sum(((F.col(f"s.{m}") == F.col(f"l.{m}")).cast("int") for m in _HASHES), F.lit(0))
    met = met.join(sets.alias("s"), "sid").join(sets.withColumnRenamed("sid", "leader").alias("l"), "leader").where(shared >= SHARED).select("sid", "leader")
    met = stored(met, "leaders")
    return met.join(met.select(F.col("sid").alias("leader")).distinct(), "leader", "left_anti").groupBy("sid").agg(F.min("leader").alias("leader"))


def _linked(n: Column, far: Column, percent: int) -> Column:
    """Whether sets with n members together that differ in ``far`` members link."""
    return 100 * (n - far) >= percent * (n + far)


def _answers(rows: DataFrame, told: DataFrame, frequent_b, k: int, percent: int, stored: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sid, lowest, links) of each set; (id, class_of_id) of ids that several sets share."""
    spark, sized = rows.sparkSession, told.where("kind = 0").select(F.col("a").alias("id"), "n", "sid")
    real = told.where("kind = 0 and n > 0 and a is not null")
    sets = stored(real.groupBy("sid").agg(F.min("a").alias("rep"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ["n", *_HASHES, *_BITS]]), "sets")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = stored(ids, "ids")
        held = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
        return rows.join(held, rows["id"] == held["rep"]).drop("rep", "id")

    # members as differences to their leaders; one that is too far leads itself
    joined = stored(_leaders(sets, stored), "joined")
    both = joined.union(joined.select("leader", "leader").distinct()).join(sets.select("sid", "rep"), "sid")
    bodies = stored(texts_of(both).mapInArrow(tidy(_sets(k, ["sid", "leader"])), "sid long, leader long, body binary"), "bodies")
    pairs = bodies.where("sid <> leader").withColumnRenamed("body", "x").join(bodies.where("sid = leader").select("leader", F.col("body").alias("y")), "leader")
    diffs = stored(pairs.select("sid", "leader", "x", "y").mapInArrow(_differences(["sid", "leader"]), "sid long, leader long, far long, diff binary"), "differences")
    close = diffs.join(sets.select("sid", "n"), "sid").where("3 * far <= 2 * n").dropDuplicates(["sid"]).drop("n")
    leader = F.coalesce("leader", "sid").alias("leader")
    homes = stored(sets.select("sid", "rep", "copies", "n").join(close, "sid", "left").select("sid", "rep", "copies", "n", leader, F.coalesce("far", F.lit(0)).alias("far"), "diff"), "homes")
    clusters = homes.groupBy("leader").agg(F.count("*").alias("size"), F.max("far").alias("radius"), F.max("n").alias("high"))
    clusters = stored(clusters.join(sets.select(F.col("sid").alias("leader"), "rep", *_BITS), "leader"), "clusters")

    # leaders that meet in the index
    postings = sets.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    buckets = max(partitions(spark), -(-int(postings) // BUCKET))
    indexed = homes.select("sid", "rep", "leader").join(clusters.select("leader", "radius", *_BITS), "leader")
    indexed = rows.join(indexed, rows["id"] == indexed["rep"]).drop("rep", "id")
    blobs = indexed.mapInArrow(tidy(_index(k, percent, buckets, frequent_b)), "bucket int, blob binary")
    met = stored(blobs.repartition(buckets, "bucket").mapInArrow(tidy(_pairs(percent)), "u long, v long").distinct(), "met")

    # what two leaders differ in
    def bodies_of(pairs: DataFrame, bits: int) -> DataFrame:
        ends = pairs.select("u").union(pairs.select("v")).distinct().join(clusters.select("leader", "rep"), F.col("u") == F.col("leader"))
        return stored(texts_of(ends.select(F.col("leader").alias("sid"), "rep")).mapInArrow(tidy(_sets(k, ["sid"], bits)), "sid long, body binary"), "bodies")

    def with_bodies(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        one = lambda end, name: bodies.select(F.col("sid").alias(end), F.col("body").alias(name))
        return pairs.join(one("u", "x"), "u").join(one("v", "y"), "v").select("u", "v", "most", "x", "y")

    told_of = lambda i, end: clusters.select(F.col("leader").alias(end), F.col("radius").alias(f"r{i}"), F.col("high").alias(f"h{i}"), F.col("size").alias(f"size{i}"))
    most = F.expr(f"(h1 + h2) * {100 - percent} div {100 + percent} + r1 + r2").alias("most")
    met = stored(met.join(told_of(1, "u"), "u").join(told_of(2, "v"), "v").select("u", "v", most), "met")
    near = stored(with_bodies(met, bodies_of(met, WIDE_BITS)).mapInArrow(_near(percent), "u long, v long, most long").distinct(), "near")
    far = with_bodies(near, bodies_of(near, 0)).mapInArrow(_differences(["u", "v", "most"]), "u long, v long, most long, far long, diff binary")
    far = far.where("far <= most").dropDuplicates(["u", "v"]).drop("most")
    far = stored(far.join(told_of(1, "u"), "u").join(told_of(2, "v"), "v"), "apart")

    # sets without members: the difference decides; else the smaller cluster's members are answers of the larger one
    single = far.where("size1 = 1 and size2 = 1").where(_linked(F.col("h1") + F.col("h2"), F.col("far"), percent)).select("u", "v")
    wide = far.where("size1 > 1 or size2 > 1").select(F.when(F.expr("size1 >= size2"), F.col("u")).otherwise(F.col("v")).alias("home"), F.when(F.expr("size1 >= size2"), F.col("v")).otherwise(F.col("u")).alias("leader"), F.col("diff").alias("shift"))
    answers = wide.join(homes, "leader").select("home", "sid", "n", "copies", F.lit(False).alias("own"), "diff", "shift")
    members = homes.join(clusters.where("size > 1").select("leader"), "leader").select(F.col("leader").alias("home"), "sid", "n", "copies", F.lit(True).alias("own"), "diff", F.lit(None).cast("binary").alias("shift"))
    answers = stored(members.union(answers), "answers")
    size = F.sum(F.coalesce(F.octet_length("diff"), F.lit(0)) + F.coalesce(F.octet_length("shift"), F.lit(0)))
    sides = answers.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).alias("sides"))
    dealt = answers.join(sides, "home").withColumn("side", F.pmod(F.xxhash64("sid"), F.col("sides"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tile = F.xxhash64("home", F.least("side", "other"), F.greatest("side", "other")).alias("tile")
    dealt = dealt.select(tile, "sid", "n", "copies", "own", "side", "diff", "shift")
    found = stored(dealt.repartition(max(partitions(spark), 8), "tile").sortWithinPartitions("tile").mapInArrow(tidy(_tiles(percent)), "sid long, links long, root long"), "found")

    # links and classes
    copies = homes.select("sid", "copies")
    ways = single.union(single.select("v", "u")).toDF("to", "sid")
    links = found.select("sid", "links").union(ways.join(copies, "sid").select("to", "copies")).groupBy("sid").agg(F.sum("links").alias("links"))
    real = sized.where("id is not null")
    shared = stored(real.groupBy("id").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least <> most").select("id"), "shared")
    own = real.join(shared, "id").where("n > 0").select("id", F.col("sid").alias("v")).distinct()
    same = stored(own.join(own.groupBy("id").agg(F.min("v").alias("u")), "id"), "same")
    comp = components(found.select(F.col("sid").alias("u"), F.col("root").alias("v")).union(single).union(same.select("u", "v")), stored=stored)
    named = sets.select("sid", "rep", "copies").join(comp, F.col("sid") == F.col("node"), "left").select("sid", "rep", "copies", F.coalesce("component", "sid").alias("component"))
    named = stored(named, "named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"))
    answer = named.join(lowest, "component").join(links, "sid", "left").select("sid", F.col("lowest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    empty = same.join(answer.select(F.col("sid").alias("u"), F.col("lowest").alias("class_of_id")), "u").select("id", "class_of_id").distinct()
    return answer, empty


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each document; n_links: documents that it links with."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    schema = "kind int, a long, n long, sid long, " + ", ".join(f"{c} long" for c in [*_HASHES, *_BITS])
    with small_batches(spark, BATCH_ROWS):
        told = stored(rows.mapInArrow(tidy(_signatures(k)), schema), "signatures")
    sized = told.where("kind = 0").select(F.col("a").alias("id"), "n", "sid")
    hot = told.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "a").limit(MAX_FREQUENT).collect()
    frequent = np.array([r["a"] for r in hot], np.int64).view(np.uint64)
    by = np.argsort(frequent)
    frequent_b = spark.sparkContext.broadcast((frequent[by], np.array([r["c"] for r in hot], np.int64)[by]))
    with scratch(spark) as short, small_batches(spark, BATCH_ROWS):
        answer, empty = (stored(d, "answer") for d in _answers(rows, told, frequent_b, k, percent, short))
    out = sized.join(answer, "sid", "left").join(empty, "id", "left")
    some = F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(some, F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.coalesce("class_of_id", "id"))).alias("component_id"),
                      F.when(some & (F.col("n") > 0), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN generate_series(1, len(ws) - 2)] END) AS sh FROM w),
m AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o WHERE 100 * i >= 90 * (nx + ny - i)),
sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, sym.y FROM r JOIN sym ON r.y = sym.x),
d AS (SELECT x, count(*) AS n FROM sym GROUP BY x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id, coalesce(d.n, 0)::BIGINT AS n_links
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id LEFT JOIN d ON d.x = s.doc_id
"""
