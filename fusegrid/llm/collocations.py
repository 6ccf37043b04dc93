"""Phrase collocations by prefix-free parsing.

1. A text's pieces are parsed into chunks: a window of ``OVERLAP`` words whose hash is divisible by ``PERIOD`` ends one chunk and begins the next, so that
   chunks overlap by that window and equal passages give equal chunks wherever they stand. The dictionary holds each distinct chunk of a language once, with its frequency in the parse.
2. Phrases of one to four words are counted inside the distinct chunks, weighted by the chunk's frequency. One that begins in the window at a chunk's end is left to the
   next chunk, which begins there; so each occurrence counts once. Pairs are looked at only where both words are frequent, longer phrases only where all pairs in them are: frequent ones are
   marked in a table of ``MARKS`` bits, of one size at any size of the input. Wrong marks cost work, never a result.
3. Scores, containment in longer candidates and ranks are joins and windows over the frequent phrases.

Defined results: null text is empty; null lang is ``und``; rows of one id are documents of their own; pieces and phrases end with a row's text; languages without a candidate, and empty tables,
have no rows; other columns are ignored. Scores, containment and counts are exact (products as decimals).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.common import byte_slices, equal_spans, in_groups, materialize, mix64, shuffle_partitions, slices, span_hashes, word_spans

LONGEST = 4
OVERLAP = LONGEST - 1
PERIOD = 16
#: Bits of a table of marks (8 MiB) and of one of the segments in which it is put together.
MARKS, SEGMENT = 1 << 26, 1 << 16
#: Bytes of chunks that are counted at a time.
COUNTED_BYTES = 8 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Lower-cases A-Z, makes tabs spaces and all that ends a piece a line feed.
_CLEAN = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[10, 32]] = True


def gram_hashes(h: np.ndarray, n: int, seed: np.uint64 | np.ndarray) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes and that of the language (of each run's first word)."""
    total = h[: max(len(h) - n + 1, 0)] * _MULT[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _MULT[k]
    return mix64(total + (seed[: len(total)] if isinstance(seed, np.ndarray) else seed))


def _seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + bytes(8), np.uint8)
    return span_hashes(data, np.zeros(1, np.int64), np.array([len(data) - 8]))[0]


def parse(texts: list[bytes], period: int = PERIOD) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a space behind each, and for each chunk its start, its end and whether it is the last of its piece."""
    data = np.frombuffer(b"\n".join(texts).translate(_CLEAN) + bytes([10] * 8), np.uint8)
    start, end = word_spans(data, _OUTSIDE)
    if not len(start):
        return b"", start, end, np.zeros(0, bool)
    piece = np.cumsum(data == 10)[start]
    keep = ~_OUTSIDE[data]
    keep[end] = True
    flat = data[keep]
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    flat[at + size] = 32
    first = np.append(True, piece[1:] != piece[:-1])
    cut = first.copy()
    if len(start) >= OVERLAP:
        window = gram_hashes(span_hashes(data, start, end), OVERLAP, np.uint64(0))
        cut[: len(window)] |= (window % np.uint64(period) == 0) & (piece[: len(window)] == piece[OVERLAP - 1 :])
    begin = np.flatnonzero(cut)
    last = np.append(first[begin[1:]], True)
    stop = np.where(last, np.append(begin[1:], len(start)), np.append(begin[1:], 0) + OVERLAP) - 1
    return flat.tobytes(), at[begin], at[stop] + size[stop] + 1, last


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk (a space behind each word), last, times: the distinct chunks of each language."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_slices(batches):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text.encode())
            for lang, some in texts.items():
                flat, start, end, last = parse(some, PERIOD)
                found = Counter(zip((flat[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)), last.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([c[0] for c in found], pa.binary()).cast(pa.string()), pa.array([c[1] for c in found], pa.bool_()), pa.array(found.values(), pa.int64())], ["lang", "chunk", "last", "times"]
                )

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, chunk string, last boolean, times long").groupBy("lang", "chunk", "last").agg(F.sum("times").alias("times"))


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Spans of bytes as an Arrow array of texts."""
    import pyarrow as pa

    end = np.cumsum(size)
    held = data[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]
    offsets = np.concatenate([[0], end]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes()))


class Words:
    """The words of some chunks: their spans and hashes, their chunks, and which begin phrases that count here."""

    def __init__(self, data: np.ndarray, size: np.ndarray, seeds: np.ndarray, last: np.ndarray):
        """``data``: the chunks one after the other, with eight bytes to spare; sizes, hashes of the language and whether the piece ends, a chunk."""
        self.data = data
        self.start, self.end = word_spans(data[:-8], _OUTSIDE)
        self.chunk = np.repeat(np.arange(len(size)), np.diff(np.searchsorted(self.start, np.append(0, np.cumsum(size)))))
        words = np.bincount(self.chunk, minlength=len(size))
        self.left = np.cumsum(words)[self.chunk] - np.arange(len(self.start))  # words from here to the chunk's end
        self.own = last[self.chunk] | (self.left > OVERLAP)
        self.seed = seeds[self.chunk]
        self.hash = span_hashes(data, self.start, self.end)

    def marked(self, n: int, marks: np.ndarray) -> np.ndarray:
        """Whether the phrase of n words that begins at each word is marked."""
        h = gram_hashes(self.hash, n, self.seed) % np.uint64(8 * len(marks))
        found = (marks[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return np.append(found, np.zeros(len(self.hash) - len(found), bool)) & (self.left >= n)

    def phrases(self, n: int, at: np.ndarray, times: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes, languages and weights of the phrases of n words that begin at the words ``at``; equal ones are added up where their bytes agree."""
        if not len(at):
            return at, at, lang[:0], times[:0]
        h = gram_hashes(self.hash, n, self.seed)[at]
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        start, size, of, weight = self.start[at], self.end[at + n - 1] - self.start[at], lang[self.chunk[at]], times[self.chunk[at]]
        new = np.append(True, h[1:] != h[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = (size == size[head]) & (of == of[head])
        same[same] = equal_spans(self.data, start[same], self.data, start[head[same]], size[same])
        new |= ~same  # one whose hash another phrase has stands for itself, and what comes after it too
        new[1:] |= ~same[:-1]
        head = np.flatnonzero(new)
        return start[head], size[head], of[head], np.add.reduceat(weight, head)


def count_phrases(chunks: DataFrame, sizes: list[int], least: int, marks=None) -> DataFrame:
    """lang, k, phrase, f: phrases of k words, for each k of ``sizes``, with f >= least; for k = 1 also a row of a null phrase with the number of all words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = None if marks is None else np.frombuffer(marks.value, np.uint8)
        names: dict[str, int] = {}
        held, size = [], 0

        def counted() -> Iterator:
            data, length, lang, last, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            seeds = np.array([_seed(x) for x in names], np.uint64)
            words = Words(np.append(data, np.zeros(8, np.uint8)), length, seeds[lang], last)
            known = pa.array(list(names), pa.string())
            for n in sizes:
                fine = words.own & (words.left >= n)
                if n == 2:
                    one = words.marked(1, table)
                    fine[:-1] &= one[:-1] & one[1:]
                elif n > 2:
                    pair = words.marked(2, table)
                    for k in range(n - 1):
                        fine[: len(fine) - k] &= pair[k:]
                start, wide, of, weight = words.phrases(n, np.flatnonzero(fine), times, lang)
                yield pa.RecordBatch.from_arrays([known.take(pa.array(of)), pa.array(np.full(len(of), n, np.int32)), _texts(words.data, start, wide), pa.array(weight)], ["lang", "k", "phrase", "f"])
                if n == 1:
                    total = np.zeros(len(names), np.int64)
                    np.add.at(total, lang[words.chunk[words.own]], times[words.chunk[words.own]])
                    yield pa.RecordBatch.from_arrays([known, pa.array(np.ones(len(names), np.int32)), pa.nulls(len(names), pa.string()), pa.array(total)], ["lang", "k", "phrase", "f"])

        for batch in byte_slices(batches, "chunk"):
            lang = batch.column("lang").dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in lang.dictionary.to_pylist()], np.int64)
            chunk = batch.column("chunk").cast(pa.binary())
            at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            data = np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]].copy()
            held.append((data, np.diff(at).astype(np.int64), code[lang.indices.to_numpy()], batch.column("last").to_numpy(zero_copy_only=False), batch.column("times").to_numpy()))
            size += len(data)
            if size >= COUNTED_BYTES:
                yield from counted()
                size = 0
        if held:
            yield from counted()

    counts = chunks.mapInArrow(run, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | F.col("phrase").isNull())


def phrase_marks(frequent: DataFrame, n: int) -> bytes:
    """The table of marks of frequent phrases of n words; of a fixed size, put together segment by segment."""
    spark = frequent.sparkSession

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(MARKS, bool)
        for batch in slices(batches, 4096):
            phrases: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                phrases.setdefault(lang, []).append(phrase.encode())
            for lang, some in phrases.items():
                data = np.frombuffer(b"\n".join(some) + bytes([10] * 8), np.uint8)
                h = span_hashes(data, *word_spans(data, _OUTSIDE))
                table[(gram_hashes(h, n, _seed(lang))[::n] % np.uint64(MARKS)).astype(np.int64)] = True
        parts = table.reshape(-1, SEGMENT)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([np.packbits(parts[i], bitorder="little").tobytes() for i in some], pa.binary())], ["segment", "bits"])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (segment,), rows in in_groups(batches, ["segment"], ["bits"]):
            bits = np.zeros(SEGMENT // 8, np.uint8)
            for (more,) in rows:
                bits |= np.frombuffer(more, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()])], ["segment", "bits"])

    kind = "segment int, bits binary"
    dealt = frequent.select("lang", "phrase").mapInArrow(mark, kind).repartition(shuffle_partitions(spark), "segment").sortWithinPartitions("segment")
    out = np.zeros((MARKS // SEGMENT, SEGMENT // 8), np.uint8)
    for batch in dealt.mapInArrow(join, kind).toArrow().to_batches():
        for segment, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[segment] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of up to four words with f >= least, and (lang, n)."""
    spark = docs.sparkSession
    chunks = materialize(dictionary(docs))
    one = materialize(count_phrases(chunks, [1], least))
    known = one.where("phrase is not null")
    two = materialize(count_phrases(chunks, [2], least, spark.sparkContext.broadcast(phrase_marks(known, 1))))
    more = materialize(count_phrases(chunks, list(range(3, LONGEST + 1)), least, spark.sparkContext.broadcast(phrase_marks(two, 2))))
    return known.union(two).union(more), one.where("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 30, contained_percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    frequent, words = frequent_phrases(docs, least)
    candidates = frequent.where("k >= 2").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    side = lambda phrase, f: frequent.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # the words of each longer candidate that another candidate may have
    inside = candidates.where("k >= 3").withColumn("w", F.split("phrase", " ")).withColumn("m", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - m + 1)")))
    longer = inside.groupBy("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase")).agg(F.max("a").alias("in_longer"))
    whole = lambda c: F.col(c).cast("decimal(20, 0)")
    stay = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * whole("in_longer") < contained_percent * whole("a"), F.lit(True)))
    rows = stay.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return rows.where(F.col("rank") <= top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with p as (select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w, count(*) as times from p group by all),
g as (select lang, k, unnest(list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: array_to_string(w[i:i+k-1], ' '))) as phrase, times
  from w, unnest([1, 2, 3, 4]) as t(k)),
f as materialized (select lang, k, phrase, sum(times)::hugeint as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by 1),
c as materialized (select *, string_split(phrase, ' ') as w from f where k >= 2 and f >= 30),
parts as materialized (select lang, k, phrase, f as a, cut, array_to_string(w[1:cut], ' ') as p, array_to_string(w[cut+1:k], ' ') as q from c, unnest([1, 2, 3]) as t(cut) where cut < k),
cuts as materialized (select s.lang, s.k, s.phrase, s.a, s.cut, l.f as l, r.f as r, (2000000 * s.a) // (l.f + r.f) as score
  from parts s join f l on l.lang = s.lang and l.phrase = s.p join f r on r.lang = s.lang and r.phrase = s.q),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select c.lang, array_to_string(c.w[i:i+m-1], ' ') as phrase, max(c.f) as f
  from c, unnest([2, 3]) as t(m), unnest([1, 2, 3]) as u(i) where m < c.k and i + m - 1 <= c.k group by all),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.f is null or 100 * i.f < 80 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n.n::bigint as n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""
