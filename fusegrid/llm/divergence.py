"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language, and by which terms.

1. An exact document frequency keeps the terms of each language that stand in enough of its documents.
2. Kept terms are dealt to shards of about a thousand; each shard gets a minimal perfect hash (bucket displacements) and its keys in the order of their slots.
3. A second pass over the texts counts: the shards are broadcast, a term is looked up, verified against the stored key, and adds one to a dense
   slot of its (language, source). Where all shards together exceed ``KEY_BYTES``, they are dealt to several passes, each under the bound, at any size of the vocabulary.
4. Slots are summed block by block (a block is a shard) in a tree of bounded fan-in, and compared block by block: for pairs of sources in tiles of ``TILE`` sources.

All arithmetic is exact: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) by long division in 64 bits (sound below 9 * 10^15 terms).

Defined results: null text, lang and source count as ''; every row is a document of its own, rows of one id too; a group without kept terms has
count 0 for each; a language without kept terms has pairs of value 0 and no terms; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import byte_slices, equal_spans, in_groups, materialize, mix64, shuffle_partitions, span_hashes, word_spans

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Keys of a shard on average, and bytes of the shards that one pass broadcasts.
SHARD_KEYS, KEY_BYTES = 1024, 32 << 20
#: Dense slots that a task holds before it gives them on (4 bytes each).
MOST_CELLS = 32 << 20
#: Packs of one (language, source, block) that one task sums, and sources of a tile.
FAN_IN, TILE = 256, 64
SCALE = 1_000_000_000
TOP = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_KIND = [("slot", "<u2"), ("count", "<i8")]


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term: terms in at least so many documents of a language, counted over all rows."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    return terms.groupBy("lang", "term").count().where(F.col("count") >= least_docs).select("lang", "term")


def _packed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all keys with eight to spare, starts and sizes."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.frombuffer(b"".join(keys) + bytes(8), np.uint8), np.cumsum(size) - size, size


def key_hashes(keys: list[bytes]) -> np.ndarray:
    data, start, size = _packed(keys)
    return span_hashes(data, start, start + size)


def _shard(h: np.ndarray, shards: int | np.ndarray) -> np.ndarray:
    return (mix64(h) % np.uint64(shards)).astype(np.int64)


def _bucket(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return ((mix64(h + _STEP) >> np.uint64(20)) % (np.asarray(n, np.uint64) // np.uint64(4) + np.uint64(1))).astype(np.int64)


def _slot(h: np.ndarray, d: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (mix64(h ^ ((d.astype(np.uint64) + np.uint64(2)) * _STEP)) % np.asarray(n, np.uint64)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets and the slot of each of n distinct hashes: all of 0..n-1. A negative displacement names the slot of a bucket's only key."""
    n = len(h)
    bucket = _bucket(h, n)
    disp, slots, free = np.zeros(n // 4 + 1, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    found, start, size = np.unique(bucket[order], return_index=True, return_counts=True)
    for i in np.argsort(-size, kind="stable").tolist():
        own = order[start[i] : start[i] + size[i]]
        if len(own) == 1:
            slots[own[0]] = np.argmax(free)
            disp[found[i]] = -1 - slots[own[0]]
        else:
            first, width = 0, 64
            while True:
                d = np.arange(first, first + width)
                at = _slot(h[own][None, :], d[:, None], n)
                apart = np.sort(at, axis=1)
                fine = np.flatnonzero(free[at].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1))
                if len(fine):
                    break
                first, width = first + width, min(width * 4, 1 << 14)
            slots[own], disp[found[i]] = at[fine[0]], d[fine[0]]
        free[slots[own]] = False
    return disp, slots


def build_shards(terms: DataFrame) -> DataFrame:
    """lang, shard, shards (of the language), disp, terms (in the order of their slots). Keys whose hash another key of the shard has already come last, beyond the hash's slots."""
    per_lang = terms.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("shards"))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_slices(batches, "term"):
            h = key_hashes([t.encode() for t in batch.column("term").to_pylist()])
            shard = _shard(h, np.array(batch.column("shards").to_pylist(), np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], [*batch.schema.names, "shard"])

    def build(table):
        import pyarrow as pa

        keys = sorted(t.encode() for t in table.column("term").to_pylist())
        h = key_hashes(keys)
        _, first = np.unique(h, return_index=True)
        disp, slots = perfect_hash(h[first])
        ordered = np.array(keys, object)
        ordered[slots] = np.array(keys, object)[first]
        ordered[len(first) :] = [keys[i] for i in sorted(set(range(len(keys))) - set(first.tolist()))]
        cols = [[table.column(c)[0].as_py()] for c in ("lang", "shard", "shards")]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array([disp.tobytes()]), pa.array([len(first)], pa.int32()), pa.array([[k.decode() for k in ordered]])], ["lang", "shard", "shards", "disp", "hashed", "terms"])

    # shards is at most a row a language
    dealt = terms.join(per_lang, "lang").mapInArrow(deal, "lang string, term string, shards int, shard int")
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards int, disp binary, hashed int, terms array<string>")


class Shards:
    """The perfect hashes of one language in one pass."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, int, list[bytes]]]):
        self.shards = shards
        self.ids = np.array([r[0] for r in rows])
        size = np.array([len(r[3]) for r in rows], np.int64)
        self.first = np.append(0, np.cumsum(size))  # dense slots of the pass
        self.at = np.full(shards, -1, np.int32)
        self.at[self.ids] = np.arange(len(rows))
        self.hashed = np.array([r[2] for r in rows], np.int64)
        disp = [np.frombuffer(r[1], np.int32) for r in rows]
        self.disp_at = np.cumsum([0, *map(len, disp)])
        self.disp = np.concatenate(disp)
        keys = [k for r in rows for k in r[3]]
        self.keys, self.key_at, self.key_size = _packed(keys)
        self.others = {k: int(self.first[i]) + j for i, r in enumerate(rows) for j, k in enumerate(r[3][r[2] :], r[2])}

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slot of each span, -1 where its bytes are no stored key."""
        size = end - start
        h = span_hashes(data, start, end)
        row = self.at[_shard(h, self.shards)]
        out = np.full(len(h), -1, np.int64)
        of = np.flatnonzero(row >= 0)
        h, row = h[of], row[of]
        n = self.hashed[row]
        d = self.disp[self.disp_at[row] + _bucket(h, n)]
        slot = self.first[row] + np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), n))
        fine = self.key_size[slot] == size[of]
        fine[fine] = equal_spans(self.keys, self.key_at[slot[fine]], data, start[of[fine]], size[of[fine]])
        out[of[fine]] = slot[fine]
        if self.others:
            for i in of[~fine].tolist():
                out[i] = self.others.get(data[start[i] : end[i]].tobytes(), -1)
        return out


def _pack(counts: np.ndarray) -> bytes:
    slot = np.flatnonzero(counts)
    return slot.astype("<u2").tobytes() + counts[slot].astype("<i8").tobytes()


def _unpack(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(cells) // 10
    return np.frombuffer(cells, "<u2", n), np.frombuffer(cells, "<i8", n, 2 * n)


def _count_pass(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, source, block, part, cells: counts of the terms of the given shards, some packs for each block."""
    held: dict[str, list] = {}
    count_of: dict[str, int] = {}
    for batch in shards.select("lang", "shard", "shards", "disp", "hashed", "terms").toArrow().to_batches():
        for lang, shard, n, disp, hashed, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(lang, []).append((shard, disp, hashed, [t.encode() for t in terms]))
            count_of[lang] = n
    found = docs.sparkSession.sparkContext.broadcast({lang: Shards(count_of[lang], sorted(rows)) for lang, rows in held.items()})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        dense: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> Iterator:
            for (lang, source), counts in dense.items():
                own = found.value[lang]
                packs = [(int(own.ids[i]), _pack(counts[own.first[i] : own.first[i + 1]])) for i in range(len(own.ids))]
                packs = [p for p in packs if p[1]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(packs), pa.string()), pa.array([source] * len(packs), pa.string()), pa.array([p[0] for p in packs], pa.int32()), pa.array([part] * len(packs), pa.int32()), pa.array([p[1] for p in packs], pa.binary())], ["lang", "source", "block", "part", "cells"])
            dense.clear()

        seen = 0
        for batch in byte_slices(batches):
            rows: dict[str, list[tuple[str, bytes]]] = {}
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if lang in found.value:
                    rows.setdefault(lang, []).append((source, text.encode()))
            for lang, some in rows.items():
                own = found.value[lang]
                # documents of one source stand together, so that each source's slots are added once
                some.sort(key=lambda r: r[0])
                data = np.frombuffer((b" ".join(r[1] for r in some) + bytes(8)).translate(_LOWER), np.uint8)
                start, end = word_spans(data, _NO_TERM)
                slot = own.find(data, start, end)
                doc_end = np.cumsum([len(r[1]) + 1 for r in some])
                cut = np.searchsorted(start, doc_end)
                begin = 0
                for i, (source, _) in enumerate(some):
                    if i + 1 < len(some) and some[i + 1][0] == source:
                        continue
                    hits = slot[begin : cut[i]]
                    begin = cut[i]
                    key = (lang, source)
                    if key not in dense:
                        if sum(map(len, dense.values())) + own.first[-1] > MOST_CELLS:
                            yield from flush()
                        dense[key] = np.zeros(own.first[-1], np.int32)
                    at, times = np.unique(hits[hits >= 0], return_counts=True)
                    dense[key][at] += times.astype(np.int32)
                seen += len(slot)
            if seen > 1 << 30:
                yield from flush()
                seen = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, block int, part int, cells binary")


def _summed(packs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Packs of one key added up; rows are dealt by the columns ``by``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, rows in in_groups(batches, keys, ["cells"]):
            total = np.zeros(1 << 16, np.int64)
            for (cells,) in rows:
                slot, count = _unpack(cells)
                total[slot] += count
            values = [pa.array([v], f.type) for v, f in zip(key, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*values, pa.array([_pack(total)], pa.binary()), pa.array([int(total.sum())], pa.int64())], [*keys, "cells", "n"])

    import pyarrow as pa

    types = {"lang": pa.string(), "source": pa.string(), "block": pa.int32(), "part": pa.int32()}
    schema = [pa.field(k, types[k]) for k in keys]
    kinds = ", ".join(f"{k} {'string' if types[k] == pa.string() else 'int'}" for k in keys)
    dealt = packs.repartition(shuffle_partitions(packs.sparkSession), *by).sortWithinPartitions(*keys).select(*keys, "cells")
    return dealt.mapInArrow(run, f"{kinds}, cells binary, n long")


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, source, block, cells, n: occurrences of the shards' terms in each source, a row for each block that has any."""
    total = shards.agg(F.sum(F.length("disp") + F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t) + 16)"))).first()[0] or 0
    passes = -(-total // KEY_BYTES)
    packs = None
    for k in range(passes):
        some = shards.where((F.col("shard").cast("long") * passes / F.col("shards")).cast("int") == k)
        if some.isEmpty():
            continue
        got = _count_pass(docs, some)
        packs = got if packs is None else packs.union(got)
    if packs is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, block int, cells binary, n long")
    packs = materialize(packs)
    fan = packs.groupBy("lang", "source", "block").count().agg(F.max("count")).first()[0] or 0
    while fan > FAN_IN:  # a tree of sums, so that no task adds up a hot source's packs alone
        packs = packs.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        packs = materialize(_summed(packs, ["lang", "source", "block", "part"], ["lang", "source", "block", "part"]))
        fan = -(-fan // FAN_IN)
    return materialize(_summed(packs, ["lang", "source", "block"], ["lang", "source", "block"]))


def shares(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)) without a product beyond 64 bits."""
    bottom = np.asarray(n, np.int64) + 2 * v
    out, rest = np.divmod(count + 2, bottom)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // bottom
        rest = rest % bottom
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _term_values(counts: DataFrame, shards: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, term, value: the TOP terms of each source and block whose share is above the language's."""
    spark = counts.sparkSession
    whole = _summed(counts, ["lang", "block"], ["lang", "block"]).select("lang", F.lit(None).cast("string").alias("source"), "block", F.lit(1).alias("role"), "cells")
    kinds = "lang string, source string, block int, role int, n long, n_lang long, v long, terms array<string>, cells binary"
    names = shards.select("lang", F.lit(None).cast("string").alias("source"), F.col("shard").alias("block"), F.lit(0).alias("role"), "terms")
    own = counts.select("lang", "source", "block", F.lit(2).alias("role"), "cells").join(sizes, ["lang", "source"])
    rows = names.unionByName(whole, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    keys = ["lang", "block"]
    columns = ["role", "source", "n", "n_lang", "v", "terms", "cells"]
    rows = rows.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "role", "source").select(*keys, *columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (lang, _), part in in_groups(batches, keys, columns):
            terms, of_lang = [], None
            for role, source, n, n_lang, v, names_here, cells in part:
                if role == 0:
                    terms = names_here
                    of_lang = np.zeros(len(terms), np.int64)
                elif role == 1:
                    slot, count = _unpack(cells)
                    of_lang[slot] = count
                else:
                    slot, count = _unpack(cells)
                    p, q = shares(count, n, v), shares(of_lang[slot], n_lang, v)
                    value = distance(p, q)
                    above = np.flatnonzero(p > q)
                    if len(above) > TOP:  # all that tie with the last place, so that names decide
                        least = np.partition(value[above], len(above) - TOP)[len(above) - TOP]
                        above = above[value[above] >= least]
                    best = sorted(((-int(value[i]), terms[slot[i]].encode(), terms[slot[i]]) for i in above))[:TOP]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best), pa.string()), pa.array([source] * len(best), pa.string()), pa.array([b[2] for b in best], pa.string()), pa.array([-b[0] for b in best], pa.int64())], ["lang", "source", "item", "value"])

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def _pair_values(counts: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, a, b, value: for a < b the sum over all kept terms."""
    spark = counts.sparkSession
    tiles = sizes.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = sizes.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    every = placed.join(blocks, "lang").select("lang", "block", "source", "n", "v", "size", "tile", other, F.lit(None).cast("binary").alias("cells"))
    full = counts.drop("n").join(placed, ["lang", "source"]).join(blocks, ["lang", "block"]).select("lang", "block", "source", "n", "v", "size", "tile", other, "cells")
    keys, columns = ["lang", "block", "i", "j"], ["tile", "source", "n", "v", "size", "cells"]
    # of a source's two rows in a group that without cells comes first
    rows = every.union(full).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    rows = rows.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "source", F.col("cells").isNotNull()).select(*keys, *columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (lang, _, i, j), part in in_groups(batches, keys, columns):
            tile, names, p, now = [], [], [], None
            for own, source, n, v, size, cells in part:
                if not names or names[-1] != source:
                    tile.append(own)
                    names.append(source)
                    p.append(np.full(size, shares(np.zeros(1, np.int64), n, v)[0]))
                if cells is not None:
                    slot, count = _unpack(cells)
                    p[-1][slot] = shares(count, n, v)
            if len(p) < 2:
                continue
            p, tile = np.stack(p), np.array(tile)
            a, b, value = [], [], []
            for x in range(len(names)):
                now = np.arange(x + 1, len(names))
                now = now[((tile[now] == j) & (tile[x] == i)) | ((tile[now] == i) & (tile[x] == j))]
                if len(now):
                    value += distance(p[x][None, :], p[now]).sum(axis=1).tolist()
                    a += [names[x]] * len(now)
                    b += [names[y] for y in now]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    return rows.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = _prepared(docs)
    groups = materialize(docs.select("lang", "source").distinct())
    shards = materialize(build_shards(kept_terms(docs, least_docs)))
    counts = recount(docs, shards)
    blocks = shards.select("lang", F.col("shard").alias("block"), F.size("terms").alias("size"))
    per_lang = blocks.groupBy("lang").agg(F.sum("size").cast("long").alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    n_lang = n.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    sizes = groups.join(n, ["lang", "source"], "left").join(per_lang, "lang").join(n_lang, "lang", "left")
    sizes = materialize(sizes.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), "v"))
    half = _pair_values(counts, blocks, sizes.drop("n_lang"))
    summed = half.select("lang", "a", "b", "value").union(half.select("lang", F.col("b"), F.col("a"), "value"))
    every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a <> b")
    pairs = every.join(summed, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = _term_values(counts, shards, sizes).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= TOP))


ORACLE_SQL = r"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by all having count(distinct row_id) >= 10),
v as (select lang, count(*) as v from kept group by 1),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as c from w join kept using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
cells as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
    1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) as p
  from g join kept k using (lang) join v using (lang) left join c using (lang, source, term) left join n using (lang, source)),
lc as (select lang, term, sum(c) as c from cells group by all),
ln as (select lang, sum(c) as n from lc group by 1),
q as (select lc.lang, lc.term, 1 + (1000000000::hugeint * (lc.c + 2)) // (ln.n + 2 * v.v) as q from lc join ln using (lang) join v using (lang)),
pv as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from cells join q using (lang, term) where c > 0 and p > q),
every as (select * from pairs union all select * from terms)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 10
"""
