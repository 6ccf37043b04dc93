"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct five-word shingles; two documents link when 100 * intersection >= percent * union. A signature holds ``HASHES``
minima; documents that agree in a band of ``ROWS`` of them are candidates. Two signatures are compared in batches of ``BATCH`` hashes: with a uniform prior of the
similarity, a pair is given up as soon as the posterior probability that it reaches the threshold falls below ``MISS``. What survives is verified on whole sets.

Equal sets are one class. Documents that candidates connect form a group; pairs are never written out for a whole group:

1. A group of up to ``MEMBERS`` documents is one task's: all its pairs are met there, but those that links found already join, and its components are known at once. Nearly all groups are such.
2. A larger group is cut into blocks, and each pair of blocks is met in a task of its own; a task returns links that join what it holds, not pairs.
3. A group of more than ``MOST_BLOCKS`` blocks is not met as a whole: each band's members meet the band's least member, in parts of a bounded size, which joins most of what links; then
   the members of each band meet on signatures, cut by size and into blocks, pairs inside one component left out, and what survives is verified.

Chances of missing a link at the threshold: 7e-9 that no band agrees at 85 %, and about ``MISS`` a batch; both fall with the similarity.

Defined results: null text, or none with words, has an empty set and links with nothing; fewer than five words are one shingle; rows of one id with several texts that have words are one document with
the links of all; a null id takes no part, its component is null and it is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.common import byte_slices, components, in_groups, materialize, mix64, shuffle_partitions, text_bytes
from fusegrid.llm.ngram_join import shingles

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Members, and their shingles, of a group, or a block of one, that one task holds; blocks up to which a group is met as a whole.
MEMBERS, SHINGLES, MOST_BLOCKS = 256, 400_000, 32
#: Rows of a block of signatures of one band.
BLOCK = 512
_XOR = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32)
_ODD = mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of a set that is not empty."""
    x, out = (s >> np.uint64(16)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, ((x[at : at + 256, None] ^ _XOR) * _ODD).min(axis=0), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sign.reshape(BANDS, ROWS).T:
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    return key.view(np.int64)


@cache
def least_matches(percent: int, hashes: int, miss: float) -> int:
    """The fewest matches of so many hashes at which the similarity reaches the threshold with a posterior probability of ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, k - m + 1), so that P(similarity >= t) = P(Binomial(k + 1, t) <= m).
    """
    t, total = percent / 100, 0.0
    for m in range(hashes + 1):
        total += math.comb(hashes + 1, m) * t**m * (1 - t) ** (hashes + 1 - m)
        if total >= miss:
            return m
    return hashes


def survivors(one: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the signatures that may reach the threshold with ``one``, after all batches."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for at in range(0, HASHES, BATCH):
        matches = matches + (others[left, at : at + BATCH] == one[at : at + BATCH]).sum(axis=1)
        fine = matches >= least_matches(percent, min(at + BATCH, HASHES), MISS)
        left, matches = left[fine], matches[fine]
        if not len(left):
            break
    return left


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets that are not empty."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def group_links(docs: list[int], roles: list[int], sets: list[np.ndarray], percent: int, comps: list[int] | None = None, across: bool = False) -> list[tuple[int, int]]:
    """Links of one group: rows of role 0 with all, then the rest with each other (``across``: only with rows of another role), without pairs that links found, or one of ``comps``, already join."""
    order = sorted((i for i in range(len(docs)) if len(sets[i])), key=lambda i: (roles[i], len(sets[i])))
    docs, sets, comps, roles = [docs[i] for i in order], [sets[i] for i in order], [(comps or docs)[i] for i in order], np.array([roles[i] for i in order])
    if len(docs) < 2:
        return []
    first: dict[int, int] = {}
    root = np.array([first.setdefault(c, i) for i, c in enumerate(comps)])  # rows of one document, or component, are one
    n, signs, out = np.array([len(s) for s in sets]), np.stack([signature(s) for s in sets]), []
    for i in range(int((roles == 0).sum()) if across else len(docs)):
        fine = (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        fine[: i + 1] = False
        if across:
            fine &= roles != 0
        others = np.flatnonzero(fine)
        for j in others[survivors(signs[i], signs[others], percent)].tolist():
            if root[i] != root[j] and links(sets[i], sets[j], percent):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
                out.append((docs[i], docs[j]))
        if (root == root[0]).all():
            break
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest of the set, bands (its keys as bytes; null of an empty set)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_slices(batches):
            n, digest, bands = [], [], []
            for s in map(shingles, text_bytes(batch)):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(s)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.binary())], ["doc_id", "n", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, bands binary")


def _bands(classes: DataFrame) -> DataFrame:
    """rep, n, band."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_slices(batches, "bands"):
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            spread = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS)) for c in ("rep", "n")]
            yield pa.RecordBatch.from_arrays([*spread, pa.array(keys)], ["rep", "n", "band"])

    return classes.select("rep", "n", "bands").mapInArrow(run, "rep long, n long, band long")


def _hub_pairs(bands: DataFrame) -> DataFrame:
    """(a, b, n): each band's least member with each of its others; a band is read once, in order, and never held."""
    rows = bands.repartition(shuffle_partitions(bands.sparkSession), "band").sortWithinPartitions("band", "rep")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        band, hub = None, None
        for batch in batches:
            at, rep, n = (batch.column(c).to_numpy() for c in ("band", "rep", "n"))
            if not len(at):
                continue
            new = np.append(band is None or at[0] != band, at[1:] != at[:-1])
            head = np.where(new, np.arange(len(at)), -1)
            np.maximum.accumulate(head, out=head)
            hubs = np.where(head >= 0, rep[head], hub if hub is not None else 0)
            band, hub = at[-1], hubs[-1]
            other = rep != hubs
            yield pa.RecordBatch.from_arrays([pa.array(hubs[other]), pa.array(rep[other]), pa.array(n[other])], ["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))


def _signs(docs: DataFrame) -> DataFrame:
    """rep, n, sign."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_slices(batches):
            sets = [shingles(t) for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["rep", "n", "sign"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, n long, sign binary").where("n > 0")


def _meet(rows: DataFrame, keys: list[str], percent: int, across: bool = False, whole: bool = False) -> DataFrame:
    """Links (a, b) within the groups of ``keys`` of rows (role, comp, doc_id, text). ``across``: in groups whose last two keys differ, only between roles.
    ``whole``: instead each id with its group's component, as (a, b) too, where it is not the least itself."""
    columns = ["role", "comp", "doc_id", "text"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "role").select(*keys, *columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, part in in_groups(batches, keys, columns):
            roles, comps, ids, sets = [], [], [], []
            for role, comp, doc, text in part:
                ids.append(doc)
                roles.append(role)
                comps.append(comp)
                sets.append(shingles((text or "").encode()))
            found = group_links(ids, roles, sets, percent, comps, across and key[-1] != key[-2])
            if whole:
                least: dict[int, int] = {}
                for a, b in found:
                    x, y = least.get(a, a), least.get(b, b)
                    joined = [k for k in {a, b, *least} if least.get(k, k) in (x, y)]
                    least.update(dict.fromkeys(joined, min(x, y)))
                found = [(k, v) for k, v in least.items() if k != v]
            else:
                found = [(min(p), max(p)) for p in found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each group of ``pairs(a, b, n)``: those needed to join all that link. n: shingles of b."""
    sized = materialize(pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).cast("int").alias("salts")))
    members = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("doc_id"), F.lit(1).alias("role"))
    heads = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    return _meet(docs.join(members.union(heads), "doc_id").withColumn("comp", F.col("doc_id")), ["a", "salt"], percent)


def _block_links(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between components within groups, from members (grp, doc_id, comp, blocks): a block meets itself and each other block of its group in tasks of their own."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "comp", "doc_id")
    return _meet(docs.join(dealt, "doc_id"), ["grp", "i", "j"], percent, across=True)


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n) of different components that share a band and whose signatures may reach the threshold; from (band, rep, n, component, sign)."""
    spark = members.sparkSession
    # sets that link have one size class or two next to each other; a class meets itself and the one below it
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    placed = members.withColumn("own", kind).withColumn("class", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    keys = ["band", "class"]
    mixed = placed.groupBy(*keys).agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("top"))
    mixed = mixed.where("lo <> hi and top = class").select(*keys, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(mixed, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group, columns = [*keys, "i", "j"], ["block", "rep", "n", "component", "own", "sign"]
    rows = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*group, *columns)
    rows = rows.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "block", "n", "rep")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (_, top, i, j), part in in_groups(batches, group, columns):
            block, rep, n, comp, own, sign = zip(*part, strict=True)
            signs = np.frombuffer(b"".join(sign), np.uint32).reshape(len(sign), HASHES)
            block, rep, n, comp, own = map(np.array, (block, rep, n, comp, own))
            a, b = [], []
            for x in np.flatnonzero(block == i).tolist():
                fine = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])) & ((own == top) | (own[x] == top))
                fine &= block == j
                fine[: x + 1] = False
                others = np.flatnonzero(fine)
                found = others[survivors(signs[x], signs[others], percent)]
                a += [x] * len(found)
                b += found.tolist()
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64()), pa.array(n[b], pa.int64())], ["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long").where("a <> b").groupBy("a", "b").agg(F.max("n").alias("n"))


def near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    own = materialize(features(docs))
    sets = own.where("n > 0 and doc_id is not null")
    classes = materialize(sets.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "bands"), "doc_id").alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")))
    pairs = materialize(_hub_pairs(_bands(classes)))
    of_class = classes.select("digest", "rep")
    repeated = sets.groupBy("doc_id").agg(F.countDistinct("digest").alias("c")).where("c > 1").select("doc_id")
    same_id = materialize(sets.select("doc_id", "digest", "n").join(repeated, "doc_id").join(of_class, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), "n"))
    edges = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    groups = components(edges(pairs.union(same_id))).join(sizes, "id", "left").select(F.col("component").alias("grp"), F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n"))
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).cast("int")
    groups = materialize(groups.join(groups.groupBy("grp").agg(blocks.alias("blocks")), "grp"))
    # a document of several texts stands for the classes of all, which are other documents' too
    joins = same_id.select(F.col("b").alias("doc_id"), F.col("a").alias("comp")).where("doc_id <> comp")
    small = groups.where("blocks <= 1").select("grp", "doc_id", F.col("doc_id").alias("comp"), F.lit(0).alias("role"))
    joined = materialize(_meet(known.join(small, "doc_id"), ["grp"], percent, whole=joins.isEmpty()).select(F.col("a").alias("id"), F.col("b").alias("component")))
    large = groups.where("blocks > 1")
    if not large.isEmpty() or not joins.isEmpty():
        links = same_id.select("a", "b").union(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))
        met = large.where(F.col("blocks") <= MOST_BLOCKS).select("grp", "doc_id", F.col("doc_id").alias("comp"), "blocks")
        links = links.union(_block_links(known, met, percent))
        huge = large.where(F.col("blocks") > MOST_BLOCKS).select(F.col("doc_id").alias("rep"))
        if not huge.isEmpty():
            first = materialize(verified(known, pairs.join(huge.withColumnRenamed("rep", "a"), "a", "left_semi"), percent))
            of_huge = huge.join(components(edges(first)), F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
            signs = _signs(known.join(huge.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"))
            members = materialize(_bands(classes).join(of_huge, "rep").join(signs, ["rep", "n"]).select("band", "rep", "n", "component", "sign"))
            links = links.union(first).union(verified(known, materialize(candidates(members, percent)), percent))
        joined = components(edges(links))
    of_class = of_class.join(joined, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = own.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
