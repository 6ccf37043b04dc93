"""N-gram Jaccard join with signature trees.

A document's set holds its distinct five-word shingles; two documents link when intersection / union >= 80 %.
A node of a signature tree holds the OR-combined bitmap of the shingles below it and the range of their set sizes. A dual traversal of
two trees (or of one against itself) drops node pairs whose largest possible overlap is too small; what is left at the leaves is compared on whole sets.

One tree over all documents would prune nothing near its root, so there is a forest, in two rounds:

1. Equal sets become one class. Classes that share minima of their hashes are dealt to the group of the least such class, in parts of a bounded
   size. Each part has a tree; the group's head is met with it first, then what did not link to the head with itself.
2. Classes of different components that share a prefix shingle form a block (of two sets that link, the first n - ceil(0.8 n) + 1 shingles in
   a common order, frequent ones last, share at least one). A large block is cut into several trees, and each pair of these is met in a task of its own.

The first round only spares the second work: the second finds every link between different components, whatever the first has found.

Words are hashed to 64 bits chunk by chunk, long ones by blake2b, and shingles from these; sets of hashes stand for sets of shingles.

Defined results: null text, or none with words, has an empty set and links with nothing; fewer than five words are one shingle; rows with one id
and several texts are one document that has the links of all these; a null id takes no part in links, and its component is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.common import components, materialize, mix64, shuffle_partitions, slices, span_hashes, text_bytes, word_hashes, word_spans  # noqa: F401

WORDS = 5
PERCENT = 80
BANDS, BINS = 8, 16
BITS = 2048
LEAF = 8
#: A shingle that stands in more prefixes than this is ordered last; the bound keeps those below 200,000.
FREQUENT, MOST_FREQUENT = 40, 200_000
#: Rows up to which a table of ids is broadcast; beyond that joins shuffle.
BROADCAST_ROWS = 200_000
#: Members, and their shingles, that meet one head in one tree of the first round.
MEMBERS_PER_TREE, SHINGLES_PER_TREE = 256, 400_000
#: Rows of a block that one tree of the second round holds.
ROWS_PER_TREE = 512
BUCKETS = 8
#: Texts that are hashed together.
HASHED_BYTES = 1 << 18
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    return next(shingle_sets([text]))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The shingles of each text. Texts are hashed together, up to so many bytes at a time; only sorting goes text by text."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < HASHED_BYTES:
            size += len(texts[end])
            end += 1
        yield from _hashed_together(texts[at:end])
        at = end


def _hashed_together(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # of bytes: A-Z only
    if not len(data):
        yield from (np.zeros(0, np.uint64) for _ in texts)
        return
    starts, ends = word_spans(data)
    w = span_hashes(data, starts, ends)
    total = np.zeros(0, np.uint64)
    if len(w) >= WORDS:
        total = w[: len(w) - WORDS + 1] * _MULT[0]
        for k in range(1, WORDS):
            total += w[k : len(w) - WORDS + 1 + k] * _MULT[k]
        total = mix64(total)
    cut = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a < WORDS:
            yield mix64((w[a:b] * _MULT[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if a < b else np.zeros(0, np.uint64)
        else:
            s = np.sort(total[a : b - WORDS + 1])  # those behind go on into the next text
            yield s[np.append(True, s[1:] != s[:-1])]


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def prefix_sizes(n: int) -> tuple[int, int]:
    """How many shingles suffice against partners of any size, and against partners at least as large."""
    any_size = n - -(-PERCENT * n // 100) + 1
    larger = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
    return any_size, larger


def band_keys(s: np.ndarray) -> list[int]:
    """Keys of pairs of minima over sixteenths of the hash range; halves without any shingle give none."""
    edge = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(60))
    full = np.append(edge[1:], len(s)) > edge
    least = np.where(full, s[np.minimum(edge, len(s) - 1)], np.uint64(0))
    key = mix64(least[0::2] * _MULT[1] + least[1::2] * _MULT[2] + np.arange(BANDS, dtype=np.uint64))
    return key[full[0::2] | full[1::2]].view(np.int64).tolist()


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest (of the set), bands."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            n, digest, bands = [], [], []
            for s in shingle_sets(text_bytes(batch)):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>")


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if its rows are few; otherwise joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(docs: DataFrame, which: DataFrame) -> DataFrame:
    """Texts of the documents in ``which`` (a column doc_id, and others), one row for each row of it."""
    return docs.join(_small(which), "doc_id")


def tree_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) among the documents of each group of ``pairs(a, b, n)``: those needed to join all that link. n: shingles of b.

    A group is a head a and its members b, cut into parts of a bounded number of members and shingles; the head's text goes to each part.
    """
    sized = materialize(pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / MEMBERS_PER_TREE, F.sum("n") / SHINGLES_PER_TREE)).cast("int").alias("salts")))
    members = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("doc_id"), F.lit(1).alias("role"))
    heads = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    rows = _texts(docs, materialize(members.union(heads)))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "salt", "role", "doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, group = None, ([], [], [])
        for batch in slices(batches):
            found = []
            for a, salt, role, doc, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "doc_id")), shingle_sets(text_bytes(batch)), strict=True):
                if (a, salt) != at:
                    found += group_links(*group)
                    at, group = (a, salt), ([], [], [])
                for held, x in zip(group, (doc, role, s), strict=True):
                    held.append(x)
            yield _pairs(pa, found)
        yield _pairs(pa, group_links(*group))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _pairs(pa, found):
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def group_links(docs: list[int], roles: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of one group by its signature tree; heads (role 0) first, then the rest, without pairs that links found already join."""
    order = sorted((i for i in range(len(docs)) if len(sets[i])), key=lambda i: len(sets[i]))
    docs, roles, sets = [docs[i] for i in order], [roles[i] for i in order], [sets[i] for i in order]
    if len(docs) < 2:
        return []
    first: dict[int, int] = {}
    root = [first.setdefault(d, i) for i, d in enumerate(docs)]  # rows of one document are one

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []

    def meet(pairs: Iterator) -> None:
        for x, y in pairs:
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                p, q = find(i), find(j)
                if p != q and links(sets[i], sets[j]):
                    root[max(p, q)] = min(p, q)
                    out.append((docs[i], docs[j]))

    bits = np.frombuffer(b"".join(map(bitmap, sets)), np.uint64).reshape(len(sets), -1)
    n = np.array([len(s) for s in sets])
    labels = lambda: np.array([find(i) for i in range(len(docs))])
    heads = np.flatnonzero(np.array(roles) == 0)
    if len(heads):
        comp = labels()
        meet((heads[x], y) for x, y in candidates_between(SignatureTree(bits[heads], n[heads], comp[heads]), SignatureTree(bits, n, comp)))
    tree = SignatureTree(bits, n, labels())
    meet(candidates_between(tree, tree))
    return out


def _in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles by hash, frequent ones last."""
    if not len(frequent):
        return s
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~often], s[often]])


def _buckets(batches: Iterator, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The packs of one bucket after the other, from rows in the order of buckets."""
    at, packs = None, []
    for batch in slices(batches):
        for k, pack in zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist(), strict=True):
            if k != at and packs:
                yield at, packs
                packs = []
            at = k
            packs.append(pack)
    if packs:
        yield at, packs


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles in more than a bounded number of prefixes, counted over all documents."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark) * BUCKETS

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1000):
            got = [s[: prefix_sizes(len(s))[0]] for part in slices([batch]) for s in shingle_sets(text_bytes(part)) if len(s)]
            tokens = np.concatenate(got) if got else np.zeros(0, np.uint64)
            bucket = (mix64(tokens) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            some = [k for k in range(parts) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([tokens[order[cut[k] : cut[k + 1]]].tobytes() for k in some], pa.binary())], ["bucket", "tokens"])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, packs in _buckets(batches, "tokens"):
            token, times = np.unique(np.frombuffer(b"".join(packs), np.uint64), return_counts=True)
            often = times > FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(times[often], pa.int64())], ["token", "times"])

    counted = materialize(texts.select("text").mapInArrow(deal, "bucket int, tokens binary").repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "token long, times long"))
    rows = counted.orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    return np.sort(rows.view(np.uint64))


def blocks(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(block, doc_id, component, n, short, trees): documents that share a prefix token with one of another component; trees: how many the block is cut into."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark) * BUCKETS
    kind = np.dtype([("token", "<u4"), ("n", "<u4"), ("doc", "<i8"), ("comp", "<i8")])  # the last bit of n: whether it suffices against larger partners

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1000):
            rows = []
            for doc, comp, s in (row for part in slices([batch]) for row in zip(part.column("doc_id").to_pylist(), part.column("component").to_pylist(), shingle_sets(text_bytes(part)), strict=True)):
                if not len(s):
                    continue
                all_n, short_n = prefix_sizes(len(s))
                tokens = _in_order(s, frequent)[:all_n]
                row = np.empty(len(tokens), [("bucket", "<u4"), *[(x, kind[x]) for x in kind.names]])
                mixed = mix64(tokens)
                row["bucket"], row["token"] = mixed % np.uint64(parts), mixed >> np.uint64(32)
                row["n"] = 2 * len(s) + (np.arange(len(tokens)) < short_n)
                row["doc"], row["comp"] = doc, comp
                rows.append(row)
            if not rows:
                continue
            row = np.concatenate(rows)
            row = row[np.argsort(row["bucket"], kind="stable")]
            cut = np.searchsorted(row["bucket"], np.arange(parts + 1))
            some = [k for k in range(parts) if cut[k] < cut[k + 1]]
            pack = lambda part: b"".join(np.ascontiguousarray(part[x]).tobytes() for x in kind.names)  # noqa: E731  columns compress better
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(row[cut[k] : cut[k + 1]]) for k in some], pa.binary())], ["bucket", "rows"])

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for k, packs in _buckets(batches, "rows"):
            cols = {x: [] for x in kind.names}
            for p in packs:
                m, at = len(p) // kind.itemsize, 0
                for x in kind.names:
                    cols[x].append(np.frombuffer(p, kind[x], m, at))
                    at += m * kind[x].itemsize
            token, n, doc, comp = (np.concatenate(cols[x]) for x in kind.names)
            order = np.argsort(token, kind="stable")
            token, n, doc, comp = token[order], n[order], doc[order], comp[order]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            mixed = (np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)) & (np.maximum.reduceat(n & 1, start) == 1)
            keep = np.repeat(mixed, size)
            name = (np.int64(k) << np.int64(32)) + token[keep].astype(np.int64)
            trees = -(-np.repeat(size, size)[keep] // ROWS_PER_TREE)
            cols = [name, doc[keep], comp[keep], (n[keep] >> 1).astype(np.int64), (n[keep] & 1) == 1, trees.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "doc_id", "component", "n", "short", "trees"])

    dealt = texts.select("doc_id", "component", "text").mapInArrow(deal, "bucket int, rows binary").repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "block long, doc_id long, component long, n long, short boolean, trees int")


class SignatureTree:
    """Documents of one block in a packed tree. Each level: OR-combined bitmaps, range of sizes, most shingles beyond bits, range of components."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        extra = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, n, n, extra, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, extra, c_lo, c_hi = self.levels[-1]
            at = np.arange(0, len(bits), LEAF)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at), np.minimum.reduceat(c_lo, at), np.maximum.reduceat(c_hi, at)))


def candidates_between(a: SignatureTree, b: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) of documents of different components that may overlap enough; each pair once if a is b."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        la, lb, x, y = stack.pop()
        keep = _possible(a.levels[la], b.levels[lb], x, y, la == lb == 0)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if la == lb == 0:
            yield x, y
            continue
        step, stay = np.arange(LEAF), np.zeros(1, np.int64)
        down_a, down_b = la >= lb, lb >= la  # the taller of the two goes down, or both
        na, nb = la - down_a, lb - down_b
        for at in range(0, len(x), 4096):
            p = (x[at : at + 4096, None] * LEAF + step if down_a else x[at : at + 4096, None] + stay)[:, :, None]
            q = (y[at : at + 4096, None] * LEAF + step if down_b else y[at : at + 4096, None] + stay)[:, None, :]
            p, q = (z.ravel() for z in np.broadcast_arrays(p, q))
            fine = (p < len(a.levels[na][0])) & (q < len(b.levels[nb][0]))
            if a is b:
                fine &= p < q if na == 0 else p <= q
            stack.append((na, nb, p[fine], q[fine]))


def _possible(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, leaves: bool) -> np.ndarray:
    """Which of the node pairs may hold two documents of different components that link."""
    bits, lo, hi, extra, c_lo, c_hi = a
    bits_b, lo_b, hi_b, extra_b, c_lo_b, c_hi_b = b
    fine = ~((c_lo[x] == c_hi[x]) & (c_lo[x] == c_lo_b[y]) & (c_hi[x] == c_hi_b[y]))
    fine &= (100 * hi[x] >= PERCENT * lo_b[y]) & (100 * hi_b[y] >= PERCENT * lo[x])
    out = np.flatnonzero(fine)
    x, y = x[out], y[out]
    most = np.bitwise_count(bits[x] & bits_b[y]).sum(1).astype(np.int64) + np.minimum(extra[x], extra_b[y])
    if leaves:  # what one has in bits that the other lacks is in no overlap
        most = np.minimum(most, np.minimum(lo[x] - np.bitwise_count(bits[x] & ~bits_b[y]).sum(1), lo_b[y] - np.bitwise_count(bits_b[y] & ~bits[x]).sum(1)))
    # the overlap must reach 80 % of the union, which is at least the larger set
    enough = (100 + PERCENT) * most >= PERCENT * (lo[x] + lo_b[y])
    return out[enough & (100 * most >= PERCENT * np.maximum(lo[x], lo_b[y]))]


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of the signature trees of all blocks, n the shingles of b."""
    spark = docs.sparkSession

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bitmap(s) for s in shingle_sets(text_bytes(batch))], pa.binary())], ["doc_id", "bits"])

    signs = _texts(docs, materialize(found.select("doc_id").distinct())).select("doc_id", "text").mapInArrow(sign, "doc_id long, bits binary")
    # a tree meets itself and each other tree of its block in a group of its own
    own = F.pmod(F.xxhash64("doc_id"), F.col("trees")).cast("int")
    every = F.sequence(F.lit(0), F.col("trees") - 1)
    dealt = found.withColumn("tree", own).select("block", "doc_id", "component", "n", "short", "tree", F.explode(every).alias("other"))
    dealt = dealt.select("block", F.least("tree", "other").alias("i"), F.greatest("tree", "other").alias("j"), "tree", "doc_id", "component", "n", "short")
    keys = ["block", "i", "j"]
    rows = dealt.join(signs, "doc_id").repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "tree", "n", "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def traverse(key, part):
            tree, doc, comp, n, short, bits = part
            if len(doc) < 2:
                return
            table = np.frombuffer(b"".join(bits), np.uint64).reshape(len(doc), -1)
            tree, doc, comp, n, short = map(np.array, (tree, doc, comp, n, short))
            sides = [np.flatnonzero(tree == k) for k in dict.fromkeys(key[1:])]
            if not all(map(len, sides)):
                return
            trees = [SignatureTree(table[s], n[s], comp[s]) for s in sides]
            for x, y in candidates_between(trees[0], trees[-1]):
                x, y = sides[0][x], sides[-1][y]
                small = np.where((n[x] < n[y]) | ((n[x] == n[y]) & short[x]), x, y)  # the smaller's first shingles suffice, either's if they are as large
                fine = short[small] & (doc[x] != doc[y])
                x, y = x[fine], y[fine]
                a, b = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b]), pa.array(n[b])], ["a", "b", "n"])

        at, part = None, ([], [], [], [], [], [])
        for batch in slices(batches, 1000):
            names = [batch.column(c).to_pylist() for c in ("block", "i", "j", "tree", "doc_id", "component", "n", "short", "bits")]
            for block, i, j, *row in zip(*names, strict=True):
                if (block, i, j) != at:
                    yield from traverse(at, part)
                    at, part = (block, i, j), ([], [], [], [], [], [])
                for held, x in zip(part, row, strict=True):
                    held.append(x)
        yield from traverse(at, part)

    return rows.mapInArrow(run, "a long, b long, n long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    own = materialize(features(docs))
    classes = materialize(own.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")))
    # a document of each class, by its id and set, so that ids of several texts are no trouble; each class is read once
    heads = own.select("doc_id", F.col("digest").alias("d"), "n", "bands").join(classes.drop("n"), (F.col("doc_id") == F.col("rep")) & (F.col("d") == F.col("digest"))).dropDuplicates(["digest"])
    bands = materialize(heads.select("rep", "n", F.explode("bands").alias("band")))
    hubs = bands.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1")
    pairs = materialize(bands.join(hubs, "band").where("rep <> a").select("a", F.col("rep").alias("b"), "n").distinct())
    repeated = own.where("n > 0").groupBy("doc_id").agg(F.countDistinct("digest").alias("c")).where("c > 1").select("doc_id")
    same_id = own.join(repeated, "doc_id").join(classes, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    first = materialize(tree_links(known, pairs).union(same_id))
    joined = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = classes.join(joined, F.col("rep") == F.col("id"), "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("component")).distinct()
    # the classes' texts are picked once, by a shuffle whatever their number, and read twice
    texts = materialize(known.join(labelled.hint("merge"), "doc_id"))
    found = materialize(blocks(texts, frequent_shingles(texts)))
    second = materialize(tree_links(known, materialize(candidates(known, found))))
    if not second.isEmpty():
        joined = components(first.union(second).select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_class = classes.join(joined, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    several = own.join(of_class, "digest", "left")
    return several.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
