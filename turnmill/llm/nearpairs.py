"""All pairs of texts with a likeness of at least T, from exact agreement in parts of the shingle domain.

Stages, all of them over all records:

1. ``features``: one row a record with its class (hash of its shingle set) and the set itself, 32 bits a shingle (all 64 from WIDE shingles on). Written to
   the shared folder. On the way each task reports the shingles that many of its classes have; summed up, they make the list of
   common shingles, whose length is bounded by (mean set size / COMMON), whatever the number of records.
2. ``keyed``: a record's keys, as packed blocks (not as rows), one for each range of keys: the classes of a block once each, with their
   size, and 4 bytes a key. The number of ranges follows the number of records, so that a range is one small piece of work.
3. ``agreements`` (one table) or ``across`` (a table of history and a batch): the blocks of a range are sorted, and classes with equal keys
   become candidate pairs, of which bitmaps rule out most at once (up to AT_HAND records). Exact copies are one class, so they meet as one key. A key with more than HOT classes (HERE * HOT with bitmaps) is not paired
   there; its classes go through a join of salted blocks.
4. ``verified``: candidates with their bitmaps, which rule out most of them for sure, then the rest with their sets, counted exactly. What a class with many
   candidates has goes to several tasks.
5. ``paired``: class pairs to pairs of ids. Classes with many members are joined in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.texts import mix, runs, word_arrays
from turnmill.session import small, tasks, written

K = 3  # words a shingle
MIN_WORDS = 20
T = 0.5
#: A shingle that more than this share of the classes (and at least COMMON_LEAST) have is common; keys are made of a set's other shingles first.
COMMON, COMMON_LEAST = 0.0003, 24
#: Sets of fewer shingles than this meet in every single shingle.
SMALL = 8
#: Classes under one key, or members of one class, from which they are joined in blocks; candidates of a class from which its set goes to several tasks.
HOT = 2000
HUB = 5000
#: Pairs up to which their classes are broadcast without being measured, and no class is looked at as a hub (one task could do them all).
FEW_PAIRS = 50_000
#: Keys a range, about.
RANGE_KEYS = 2_000_000
KEYS_A_SET = 240
#: Records up to whose number the tasks in which keys meet read all bitmaps (136 bytes a class), so that candidates are ruled out there; there a key of up to HERE * HOT classes is paired at once.
AT_HAND = 500_000
HERE = 3
#: Sets of this many shingles or more keep all 64 bits of a shingle. The 32 bits of the others, and of pairs with one of these, lose no pair: shingles that agree in them are counted as often as they occur.
WIDE = 512

#: Keys of sets, from the hash and the set of each shingle, by set and then by the common order, and the sizes of the sets.
Keys = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

FEATURES = "tbl int, id string, grp int, cid long, n int, sh binary, bits binary, seen int"
#: Bits of a set's bitmap.
BITS = 1024
MET = "a long, b long, key long, grp int, blocks int"


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts, the offsets of the texts in them, and the number of words of each."""
    w, ends = word_arrays(texts)
    h, owner = runs(w, ends, K)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for lo, hi in zip(edges, edges[1:], strict=False):
        h[lo:hi].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
    size = np.bincount(owner[new], minlength=len(texts))
    return h[new], np.concatenate(([0], np.cumsum(size))), np.diff(ends)


def _times(x: np.ndarray) -> np.ndarray:
    """How often each element has come before, where equal ones stand together."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])
    return np.zeros(len(x), np.uint64) if len(first) == len(x) else _ramp(np.diff(np.concatenate((first, [len(x)])))).astype(np.uint64)


def class_ids(h: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hash of each set of 64-bit shingles; salt keeps the tables apart."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(0x51ED270B0A1F39C1)))))
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(salt.astype(np.uint64) + np.uint64(77)))


def bitmaps(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS bits a set (a row of 64-bit words): one for each place that a shingle falls to."""
    out = np.zeros((len(at) - 1, BITS // 64), np.uint64)
    place = (mix(sh.astype(np.uint64) + np.uint64(0x1234567)) >> np.uint64(40)) % np.uint64(BITS)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_or.at(out, (owner, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out


def features(df: DataFrame, text_of: Callable[[str | None], str | None], name: str, counted_group: int | None = None) -> DataFrame:
    """df has tbl int, id string, grp int, body string. Records that don't parse or have under MIN_WORDS words give no row; nor do null ids.

    ``counted_group``: only classes of this group count for the common shingles, and the table is laid out by group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.empty(0, np.uint32), np.empty(0, np.int64)
        known: set[int] = set()
        classes = 0
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                p = b.slice(lo, 2000)
                bodies, kinds = p["body"].to_pylist(), p["tbl"].to_numpy()
                h, at, words = shingle_sets([text_of(x) for x in bodies])
                cid = class_ids(h, at, kinds).view(np.int64)
                sh = (h >> np.uint64(32)).astype(np.uint32)
                keep = np.flatnonzero((words >= MIN_WORDS) & np.array([x is not None for x in p["id"].to_pylist()], dtype=bool))
                rows = p.take(pa.array(keep))
                n = np.diff(at)[keep]
                sets = [_stored(h[at[i] : at[i + 1]], sh[at[i] : at[i + 1]]) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [rows["tbl"], rows["id"], rows["grp"], pa.array(cid[keep]), pa.array(n.astype(np.int32)), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in bitmaps(sh, at)[keep]], pa.binary()), pa.nulls(len(keep), pa.int32())],
                    ["tbl", "id", "grp", "cid", "n", "sh", "bits", "seen"],
                )
                groups = p["grp"].to_pylist() if counted_group is not None else None
                new = [i for i in keep if cid[i] not in known and (groups is None or groups[i] == counted_group)]
                known.update(cid[i] for i in new)
                classes += len(new)
                if len(known) > 1_000_000:  # the counts serve speed only; a class met again may count again
                    known.clear()
                if new:
                    u, c = np.unique(np.concatenate([sh[at[i] : at[i + 1]] for i in new]), return_counts=True)
                    counted = _merged(*counted, u[c > 1], c[c > 1])
                    if len(counted[0]) > 2_000_000:
                        often = counted[1] > COMMON / 4 * classes
                        counted = counted[0][often], counted[1][often]
        u, c = counted
        hot = c >= max(2, COMMON * classes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([-1], pa.int32()), pa.array([classes], pa.int64()), pa.nulls(1, pa.int32()), pa.array([u[hot].tobytes() + c[hot].astype(np.uint32).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([int(hot.sum())], pa.int32())],
            ["tbl", "id", "grp", "cid", "n", "sh", "bits", "seen"],
        )

    return written(df.mapInArrow(run, FEATURES), name, by=None if counted_group is None else "grp")


def _stored(h: np.ndarray, sh: np.ndarray) -> bytes:
    """A set as it is kept: the upper 32 bits of each shingle, then from WIDE shingles on the lower ones."""
    return sh.tobytes() + (h.astype(np.uint32).tobytes() if len(h) >= WIDE else b"")


def _is_wide(x: bytes) -> bool:
    return len(x) >= 8 * WIDE


def _upper(x: bytes) -> bytes:
    """The upper 32 bits of a set's shingles."""
    return x[: len(x) // 2] if _is_wide(x) else x


def _whole(x: bytes) -> np.ndarray:
    """All bits of a wide set's shingles."""
    upper, lower = np.frombuffer(x, np.uint32).reshape(2, -1).astype(np.uint64)
    return (upper << np.uint64(32)) | lower


def _merged(u: np.ndarray, c: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate((u, v))
    w, at = np.unique(both, return_inverse=True)
    return w, np.bincount(at, weights=np.concatenate((c, d)), minlength=len(w)).astype(np.int64)


def common_shingles(feats: DataFrame) -> np.ndarray:
    """Shingles that over COMMON of all classes have, the most frequent last. At most (mean set size / COMMON) of them; a row a task comes to the driver."""
    u, c, classes = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    for r in feats.where("tbl = -1").select("cid", "sh", "seen").toLocalIterator():
        a = np.frombuffer(bytes(r["sh"]), np.uint32)
        u, c = _merged(u, c, a[: r["seen"]], a[r["seen"] :].astype(np.int64))
        classes += r["cid"]
    often = c >= max(COMMON_LEAST, COMMON * classes)
    return u[often][np.argsort(c[often], kind="stable")]


def rows_of(feats: DataFrame) -> DataFrame:
    return feats.where("tbl >= 0")


def _places(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x stands in the table (sorted), or would stand. Looked up in order, so that searches go by what is near in memory."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(table, x[order])
    return out


def _maybe_asked(k: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in k of all keys (32 bits) that are asked for, and of a few more: those that agree with one in the upper 22 bits."""
    upper = np.zeros(1 << 22, bool)
    upper[asked >> np.uint32(10)] = True
    return np.flatnonzero(upper[k >> np.uint32(10)])


def two_of_a_group(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets of SMALL shingles or more: two sets of likeness T = 0.5 or more have one in common, whatever they hold.

    A key is two shingles of one group; a shingle's group goes by its hash. Sets are in bands of sizes, powers of two from SMALL on; two like sets meet by the groups of the
    larger one's band, so each set is taken by its own band and by the next. It shares at least ``alpha`` shingles there: half of its own number with sets of its band or
    the one below, a third of both numbers with those of the next. Its first shingles in the common order that make n - alpha + 1, each group counting one less than it has of them, give
    all their twos. Whichever of two sets stops first lacks at most n - alpha of these in the other, but to share no two of a group it would lack n - alpha + 1. There are fewer
    groups than alpha, so a set's shingles always suffice.
    """
    out_k, out_o = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    many = np.bincount(owner, minlength=len(size))
    start = np.cumsum(many) - many
    band = np.floor(np.log2(np.maximum(size, SMALL) / SMALL)).astype(np.int64)
    upper = h >> np.uint64(32)
    for up in (0, 1):
        low = np.left_shift(SMALL, band + up)
        alpha = -(-(size + low) // 3) if up else -(-size // 2)
        groups = (low // 2 - 1).astype(np.uint64)
        group = (upper * np.repeat(groups, many)) >> np.uint64(32)
        s, p = _by_slot(owner, group, len(size))
        counts = np.empty(len(p), np.int64)
        counts[p] = np.concatenate(([0], s[1:] == s[:-1]))[: len(p)]
        before = np.concatenate(([0], np.cumsum(counts)))
        ok = before[:-1] < np.repeat(before[start] + size - alpha + 1, many)
        some = np.flatnonzero(ok.take(p))
        s, p = s.take(some), p.take(some)
        i, step = np.arange(len(p)), 1
        while len(i := i[: np.searchsorted(i, len(p) - step)]) and len(i := i[s.take(i) == s.take(i + step)]):
            a, b = p.take(i), p.take(i + step)
            if up:  # most twos of the next band are twos of the own
                new = np.flatnonzero((own.take(a) != own.take(b)) | ~(taken.take(a) & taken.take(b)))
                a, b = a.take(new), b.take(new)
            out_k.append(mix(h.take(a) + h.take(b)))
            out_o.append(owner.take(a))
            step += 1
        own, taken = group, ok
    return np.concatenate(out_k), np.concatenate(out_o)


def _by_slot(owner: np.ndarray, group: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by set, group and place: the slot (set and group) and the place of each."""
    places, groups = len(owner).bit_length(), int(group.max(initial=0)).bit_length()
    slot = (owner.astype(np.uint64) << np.uint64(groups)) | group
    if sets.bit_length() + groups + places > 64:
        p = np.argsort(slot, kind="stable")
        return slot[p], p
    x = np.sort((slot << np.uint64(places)) | np.arange(len(owner), dtype=np.uint64))  # faster than by index
    return x >> np.uint64(places), (x & np.uint64((1 << places) - 1)).astype(np.int64)


def keys_of(sh: np.ndarray, at: np.ndarray, common: np.ndarray, salt: np.ndarray, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, and the index of the set; every shingle for sets below 2 * SMALL. Two sets of likeness T or more have a key in common.

    Each set's shingles (their upper 32 bits) are in order. Those of one set that agree in these bits are told apart by how often they have come before, so a set keeps its size and two sets share at least what they share by all bits.
    The common order has the shingles that are not common first, then the common ones as they stand in ``common``. It serves speed; any order that all sets have in common finds the same pairs.
    """
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    place = (sh.astype(np.uint32) * np.uint32(0x9E3779B1)).astype(np.uint64)
    if len(common):
        by = np.argsort(common)
        table = common[by]
        i = np.minimum(_places(table, sh), len(by) - 1)
        some = np.flatnonzero(table[i] == sh)
        place[some] = np.uint64(1 << 32) + by[i[some]].astype(np.uint64)
    times = _times((owner.astype(np.uint64) << np.uint64(32)) | sh)
    m = np.flatnonzero((n >= SMALL)[owner])
    m = m[np.argsort((owner[m].astype(np.uint64) << np.uint64(33)) | place[m], kind="stable" if times.any() else None)]
    h = mix(sh.astype(np.uint64) | (times << np.uint64(32)))
    k, o = keys(h[m], owner[m], n)
    # a set below SMALL can only be like sets below 2 * SMALL
    single = (n < 2 * SMALL)[owner]
    one = mix(h[single] ^ salt[owner[single]] ^ np.uint64(3))
    return np.concatenate((mix(k ^ salt[o] ^ mix(np.full(1, 1, np.uint64))), one)), np.concatenate((o, owner[single]))


def ranges(spark: SparkSession, records: int) -> int:
    """Number of ranges of keys for so many records."""
    return max(tasks(spark), -(-records * KEYS_A_SET // RANGE_KEYS))


def _block(key: np.ndarray, of: np.ndarray, cid: np.ndarray, n: np.ndarray) -> bytes:
    """Keys of one range (of: ascending index of the class) as bytes: the classes, their numbers of keys and (up to 65,535) sizes, then the keys."""
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    c = of[first]
    many = np.diff(np.concatenate((first, [len(of)])))
    return b"".join((np.uint32(len(c)).tobytes(), cid[c].tobytes(), many.astype(np.uint32).tobytes(), np.minimum(n[c], 0xFFFF).astype(np.uint16).tobytes(), key.astype(np.uint32).tobytes()))


def _unblocked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and for each its class and the size of the set."""
    out: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.uint32, np.int64, np.uint16)]
    for x in blocks:
        m = int(np.frombuffer(x, np.uint32, 1)[0])
        many = np.frombuffer(x, np.uint32, m, 4 + 8 * m)
        out[0].append(np.frombuffer(x, np.uint32, -1, 4 + 14 * m))
        out[1].append(np.repeat(np.frombuffer(x, np.int64, m, 4), many))
        out[2].append(np.repeat(np.frombuffer(x, np.uint16, m, 4 + 12 * m), many))
    k, c, n = (np.concatenate(x) for x in out)
    return k, c, n


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on; numpy sorts those of 16 bits by radix."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def keyed(feats: DataFrame, common: np.ndarray, keys: Keys, names: np.ndarray) -> DataFrame:
    """(part, block): the keys of all classes; ``names``: the number each range goes by. A range and 32 bits are what is kept of a key."""
    shared = feats.sparkSession.sparkContext.broadcast((common, names))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        common, names = shared.value
        parts = np.uint64(len(names))

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([x[0] for x in held])
            cid, n = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            of = np.concatenate([x[1] + d for x, d in zip(held, np.cumsum([0] + [len(x[2]) for x in held]), strict=False)])
            to = (((key >> np.uint64(32)) * parts) >> np.uint64(32)).astype(np.int64)
            order = _order(of)
            order = order[_order(to[order])]
            key, of, to = key[order], of[order], to[order]
            cut = np.searchsorted(to, np.arange(len(names) + 1))
            p = np.flatnonzero(cut[1:] > cut[:-1])
            for lo in range(0, len(p), 1000):
                q = p[lo : lo + 1000]
                blocks = [_block(key[cut[i] : cut[i + 1]] & np.uint64(0xFFFFFFFF), of[cut[i] : cut[i + 1]], cid, n) for i in q]
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                p = b.slice(lo, 2000)
                cid, n, kinds = (p[x].to_numpy(zero_copy_only=False) for x in ("cid", "n", "tbl"))
                new = [i for i, x in enumerate(cid.tolist()) if x not in known and not known.add(x)]
                if len(known) > 1_000_000:  # sent again, and dropped where the keys meet
                    known.clear()
                if not new:
                    continue
                new = np.array(new)
                sh = np.frombuffer(b"".join(map(_upper, p["sh"].take(pa.array(new)).to_pylist())), np.uint32)
                at = np.concatenate(([0], np.cumsum(n[new], dtype=np.int64)))
                k, o = keys_of(sh, at, common, mix(kinds[new].astype(np.uint64) + np.uint64(5)), keys)
                held.append((k, o, cid[new], n[new]))
                size += len(k)
                if size > 1_500_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return rows_of(feats).select("tbl", "cid", "n", "sh").mapInArrow(emit, "part int, block binary")


def _sized(nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The distance to the empty set alone rules out sizes that are too far apart."""
    return np.maximum(nx, ny).astype(np.float32) * T <= np.minimum(nx, ny)


_held: tuple[list[str], tuple[np.ndarray, ...]] | None = None


def files_of(records: int, *tables: DataFrame) -> list[str]:
    """Files in which tasks find the bitmaps of the tables' classes; none if there are too many records or the files aren't on a mounted folder. Then all candidates are written and ruled out by joins."""
    files = [f for t in tables for f in t.inputFiles()] if records <= AT_HAND else []
    return files if all(f.startswith("file:/") for f in files) else []


def _at_hand(files: list[str]) -> tuple[np.ndarray, ...] | None:
    """Classes (sorted), sizes and bitmaps in the files. Kept by the worker until it is asked for others."""
    global _held
    if files and (_held is None or _held[0] != files):
        _held = None
        cid, n, bits = [], [], []
        for f in files:
            t = pq.ParquetFile(unquote(urlparse(f).path)).read(["cid", "n", "bits"])
            t = t.filter(t["bits"].is_valid())
            cid.append(t["cid"].to_numpy())
            n.append(t["n"].to_numpy())
            bits.append(np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64))
        c, first = np.unique(np.concatenate(cid), return_index=True)
        _held = files, (c, np.concatenate(n)[first].astype(np.int64), np.concatenate(bits)[first])
    return _held[1] if files else None


def _differ_little(x: np.ndarray, y: np.ndarray, n: np.ndarray, threshold: float = T) -> np.ndarray:
    """Which pairs of bitmaps may be of sets (n: their sizes' sum) that reach the threshold. Places that only one bitmap has are at most as many as shingles that only one set has."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (1 + threshold) <= n * (1 - threshold) + 1e-9


def _ruled(seen: list[np.ndarray], held: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Of pairs of places in the classes held (32 bits each), the classes of those that the bitmaps don't rule out."""
    cid, n, bits = held
    p = np.sort(np.concatenate([np.empty(0, np.uint64), *seen]))
    p = p[np.concatenate(([True], p[1:] != p[:-1]))[: len(p)]]
    out = []
    for lo in range(0, len(p), 4000):  # so few that their bitmaps stay near the processor
        a, b = (p[lo : lo + 4000] >> np.uint64(32)).astype(np.int64), (p[lo : lo + 4000] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = np.flatnonzero(_differ_little(bits.take(a, 0), bits.take(b, 0), n[a] + n[b]))
        out.append(np.stack((cid[a[ok]], cid[b[ok]]), 1))
    return out


def _hot_rows(key: int, c: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """Classes of one key, to be joined in blocks."""
    m = len(c)
    return pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(m, pa.int64()), pa.array(np.full(m, key, np.int64)), pa.array(g.astype(np.int32)), pa.array(np.full(m, m // HOT + 1, np.int32))], ["a", "b", "key", "grp", "blocks"])


def agreements(feats: DataFrame, common: np.ndarray, keys: Keys) -> DataFrame:
    """Distinct pairs (a, b) of classes, a < b, that have a key in common."""
    spark = feats.sparkSession
    records = rows_of(feats).count()
    parts, files = ranges(spark, records), files_of(records, feats)
    limit = HOT * HERE if files else HOT

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for p, x in zip(b["part"].to_pylist(), b["block"].to_pylist(), strict=True):
                by.setdefault(p, []).append(x)
        for p in list(by):
            yield from one(p, by.pop(p))

    def one(part: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        k, c, n = _unblocked(blocks)
        order = np.argsort(k)
        k = k[order]
        again = np.concatenate(([False], k[1:] == k[:-1]))
        some = again | np.concatenate((again[1:], [False]))
        order, k = order[some], k[some]  # keys that occur once are most
        c, n = c[order], n[order]
        order = np.lexsort((c, k))
        k, c, n = k[order], c[order], n[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        k, c, n = k[new[: len(k)]], c[new[: len(k)]], n[new[: len(k)]]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        length = np.diff(np.concatenate((first, [len(k)])))
        hot = length > limit
        for i in np.flatnonzero(hot):
            s = slice(first[i], first[i] + length[i])
            yield _hot_rows((part << 32) | int(k[first[i]]), c[s], np.zeros(length[i]))
        first, length = first[~hot], length[~hot]
        held = _at_hand(files)
        at = None if held is None else _places(held[0], c).astype(np.uint64)
        step, seen, size = 1, [], 0
        while len(first):  # classes that stand `step` apart under one key
            ok = length > step
            first, length = first[ok], length[ok]
            if not len(first):
                break
            total = np.cumsum(length - step)
            for lo in range(0, int(total[-1]), 1_000_000):
                some = slice(np.searchsorted(total, lo, "right"), np.searchsorted(total, lo + 1_000_000, "right"))
                many = (length - step)[some]
                i = np.repeat(first[some], many) + _ramp(many)
                j = i + step
                ok = (c[i] != c[j]) & _sized(n[i], n[j])
                i, j = i[ok], j[ok]  # a key's classes are in order
                seen.append(np.stack((c[i], c[j]), 1) if at is None else (at[i] << np.uint64(32)) | at[j])
                size += len(i)
                if size > 2_000_000:
                    yield _pairs(seen if held is None else _ruled(seen, held))
                    seen, size = [], 0
            step += 1
        yield _pairs(seen if held is None else _ruled(seen, held))

    met = written(_by_part(keyed(feats, common, keys, np.arange(parts, dtype=np.int32)), parts).mapInArrow(meet, MET), "agreements")
    found = met.where("b is not null").select("a", "b")
    if met.where("b is null").limit(1).count():
        x = met.where("b is null")
        found = found.unionByName(_hot_pairs(x, x).where("a < b"))
    return found.distinct()


def across(history: DataFrame, batch: DataFrame, files: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of a class of the batch and one of the history that have a key in common; both are tables of ``keyed``. files: see ``files_of``."""
    limit = HOT * HERE if files else HOT

    def meet(old: pa.Table, new: pa.Table) -> pa.Table:
        if not old.num_rows or not new.num_rows:
            return _pairs([]).schema.empty_table()
        k, c, n = _unblocked(old["block"].to_pylist())
        q, d, m = _unblocked(new["block"].to_pylist())
        # what the batch doesn't ask for is left out before anything is sorted
        ok = _maybe_asked(k, q)
        k, c, n = k[ok], c[ok], n[ok]
        order = np.argsort(k)
        k, c, n = k[order], c[order], n[order]
        order = np.argsort(q)
        q, d, m = q[order], d[order], m[order]
        lo, hi = np.searchsorted(k, q, "left"), np.searchsorted(k, q, "right")
        out = []
        times = np.searchsorted(q, q, "right") - np.searchsorted(q, q, "left")
        hot = (hi - lo > limit) | ((times > limit) & (hi > lo))
        for x in np.unique(q[hot]):
            key = (int(new["part"][0].as_py()) << 32) | int(x)
            a, z = np.searchsorted(k, x, "left"), np.searchsorted(k, x, "right")
            cs, ds = np.unique(c[a:z]), np.unique(d[q == x])
            both = pa.Table.from_batches([_hot_rows(key, cs, np.zeros(len(cs))), _hot_rows(key, ds, np.ones(len(ds)))])
            blocks = pa.array(np.full(len(both), max(len(cs), len(ds)) // HOT + 1, np.int32))
            out.append(both.set_column(4, "blocks", blocks))
        lo, hi, d, m = lo[~hot], hi[~hot], d[~hot], m[~hot]
        held = _at_hand(files)
        if held is not None:  # classes that aren't there are of no accepted record
            old_at = _places(held[0], c)
            ok = held[0][np.minimum(old_at, len(held[0]) - 1)] == c
            lo, hi = (np.concatenate(([0], np.cumsum(ok)))[x] for x in (lo, hi))
            c, n, old_at = c[ok], n[ok], old_at[ok].astype(np.uint64)
            new_at = _places(held[0], d).astype(np.uint64)
        total = np.cumsum(hi - lo)
        for a in range(0, int(total[-1]) if len(total) else 0, 2_000_000):
            some = slice(np.searchsorted(total, a, "right"), np.searchsorted(total, a + 2_000_000, "right"))
            many = (hi - lo)[some]
            j = np.repeat(lo[some], many) + _ramp(many)
            i = np.repeat(np.arange(len(d))[some], many)
            ok = (d[i] != c[j]) & _sized(m[i], n[j])
            i, j = i[ok], j[ok]
            out.append(pa.Table.from_batches([_pairs([np.stack((d[i], c[j]), 1)] if held is None else _ruled([(new_at[i] << np.uint64(32)) | old_at[j]], held))]))
        return pa.concat_tables(out) if out else _pairs([]).schema.empty_table()

    met = written(history.groupBy("part").cogroup(batch.groupBy("part")).applyInArrow(meet, MET), "agreements")
    found = met.where("b is not null").select("a", "b")
    if met.where("b is null").limit(1).count():
        x = met.where("b is null")
        found = found.unionByName(_hot_pairs(x.where("grp = 1"), x.where("grp = 0")).where("a <> b"))
    return found.distinct()


def _by_part(df: DataFrame, parts: int) -> DataFrame:
    """Each value of part to a partition of its own."""
    return df.repartitionById(parts, F.col("part")) if hasattr(df, "repartitionById") else df.repartition(parts, "part")


def _hot_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs under keys with many classes: the classes of a key fall into blocks of about HOT, and each two blocks meet in a task of their own."""
    put = lambda df: df.select("key", "a", "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("blk"))
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = put(x).select("key", "a", F.col("blk").alias("i"), to.alias("j"))
    right = put(y).select("key", F.col("a").alias("b"), F.col("blk").alias("j"), to.alias("i"))
    return left.join(right.hint("merge"), ["key", "i", "j"]).select("a", "b")


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _pairs(seen: list[np.ndarray]) -> pa.RecordBatch:
    """The distinct ones of pairs of classes."""
    p = np.concatenate([np.empty((0, 2), np.int64), *seen])
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.concatenate(([True], (p[1:] != p[:-1]).any(1)))] if len(p) else p
    n = len(p)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], ["a", "b", "key", "grp", "blocks"])


def likeness(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Jaccard similarity of the sets (as ``_stored``) of each pair, of 65,535 pairs at most. By all 64 bits of a shingle if both sets are wide, else by the upper 32, which never gives less."""
    n = len(x)
    ux, uy = [_upper(v) for v in x], [_upper(v) for v in y]
    nx, ny = np.array([len(v) for v in ux]) // 4, np.array([len(v) for v in uy]) // 4
    sides = [(np.repeat(np.arange(n), m).astype(np.uint64) << np.uint64(32)) | np.frombuffer(b"".join(v), np.uint32) for m, v in ((nx, ux), (ny, uy))]
    key = np.sort(np.concatenate([k | (_times(k) << np.uint64(48)) for k in sides]))
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64), minlength=n)
    for i in range(n):
        if _is_wide(x[i]) and _is_wide(y[i]):
            both[i] = len(np.intersect1d(_whole(x[i]), _whole(y[i]), assume_unique=True))
    return both / np.maximum(1, nx + ny - both)


def _with(pairs: DataFrame, side: str, other: str, table: DataFrame, columns: dict[str, str], few: bool) -> DataFrame:
    """pairs with columns (name: new name) of the class in column ``side``. What a class in more than HUB pairs has is copied, once for each HUB of them; of few pairs nothing is."""
    names = [F.col("cid").alias(side), *(F.col(c).alias(n) for c, n in columns.items())]
    if few:
        asked = F.broadcast(pairs.select(F.col(side).alias("cid")).distinct())
        return pairs.join(table.select("cid", *columns).join(asked, "cid", "left_semi").dropDuplicates(["cid"]).select(*names), side)
    need = written(pairs.groupBy(F.col(side).alias("cid")).count(), "need")
    # few enough classes are sent to the table; else the table is shuffled
    one = table.select("cid", *columns).join(small(need.select("cid")), "cid", "left_semi").dropDuplicates(["cid"]).select(*names)
    hubs = need.where(f"count > {HUB}").select(F.col("cid").alias(side), (F.col("count") / HUB).cast("int").alias("_more"))
    if not hubs.limit(1).count():
        return pairs.join(one, side)
    hubs = small(hubs)
    more = F.coalesce("_more", F.lit(0))
    one = one.join(hubs, side, "left").withColumn("_blk", F.explode(F.sequence(F.lit(0), more))).drop("_more")
    p = pairs.join(hubs, side, "left").withColumn("_blk", F.pmod(F.xxhash64(other), more + 1).cast("int")).drop("_more")
    return p.join(one, [side, "_blk"]).drop("_blk")


def verified(pairs: DataFrame, table_a: DataFrame, table_b: DataFrame, threshold: float = T) -> DataFrame:
    """(a, b, likeness) of the pairs of classes that reach the threshold.

    Bitmaps come first: they rule out pairs for sure, for a few bytes a pair. The sets of the others are counted.
    """
    pairs = written(pairs, "candidates")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("x", "y"))
            ok = pa.array(np.flatnonzero(_differ_little(x, y, b["n"].to_numpy().astype(np.int64) + b["m"].to_numpy(), threshold)))
            yield pa.RecordBatch.from_arrays([b["a"].take(ok), b["b"].take(ok)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                s = likeness(p["x"].to_pylist(), p["y"].to_pylist())
                ok = pa.array(np.flatnonzero(s >= threshold))
                yield pa.RecordBatch.from_arrays([p["a"].take(ok), p["b"].take(ok), pa.array(s).take(ok)], ["a", "b", "likeness"])

    few = pairs.count() <= FEW_PAIRS
    seen = _with(_with(pairs, "a", "b", table_a, {"n": "n", "bits": "x"}, few), "b", "a", table_b, {"n": "m", "bits": "y"}, few)
    left = written(seen.select("a", "b", "n", "m", "x", "y").mapInArrow(possible, "a long, b long"), "possible")
    few = few or left.count() <= FEW_PAIRS
    joined = _with(_with(left, "a", "b", table_a, {"sh": "x"}, few), "b", "a", table_b, {"sh": "y"}, few)
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, likeness double")


def members(feats: DataFrame) -> DataFrame:
    return rows_of(feats).select("tbl", "id", "cid").distinct()


def _spread(m: DataFrame, cid: str, blk: str) -> tuple[DataFrame, DataFrame | None]:
    """Members of classes with a block for classes of more than HOT members, and the number of blocks of these."""
    hot = m.groupBy(cid).count().where(f"count > {HOT}").select(cid, (F.col("count") / HOT + 1).cast("int").alias("_blocks"))
    if not hot.limit(1).count():
        return m.withColumn(blk, F.lit(0)), None
    hot = small(written(hot, "hot"))
    of = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).cast("int")
    return m.join(hot, cid, "left").withColumn(blk, of).drop("_blocks"), hot


def _over_blocks(links: DataFrame, cid: str, blk: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return links.withColumn(blk, F.lit(0))
    return links.join(hot, cid, "left").withColumn(blk, F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")


def paired(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(tbl, i, j, same): the members of each two linked classes (a, b); a class may be linked with itself. left, right: ``members``; further columns of theirs follow."""
    more = [c for c in left.columns if c not in ("tbl", "id", "cid")]
    l, lh = _spread(left.select("tbl", "id", F.col("cid").alias("a"), *(F.col(c).alias(f"_l_{c}") for c in more)), "a", "p")
    r, rh = _spread(right.select("id", F.col("cid").alias("b"), *(F.col(c).alias(f"_r_{c}") for c in more)), "b", "q")
    p = _over_blocks(_over_blocks(links.select("a", "b"), "a", "p", lh), "b", "q", rh)
    p = p.join(l.withColumnRenamed("id", "i"), ["a", "p"]).join(r.withColumnRenamed("id", "j"), ["b", "q"])
    return p.select("tbl", "i", "j", F.col("a") == F.col("b"), *(f"_l_{c}" for c in more), *(f"_r_{c}" for c in more))


def expanded(feats: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b, each pair once: of linked classes, and of the members of one class."""
    m = members(feats)
    same = m.groupBy("cid").count().where("count > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    p = paired(links.select("a", "b").unionByName(same), m, m).toDF("tbl", "i", "j", "same")
    return p.where("i < j or (i > j and not same)").select("tbl", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
