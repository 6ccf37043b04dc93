"""Toxicity by a lexicon trie met with Levenshtein automata, weighed by the words around.

The lexicon (whole terms, and stems that any ending may follow) is learned from labelled rows: words and word
beginnings that stand in toxic documents far more surely than chance. A document's words walk the trie and a Levenshtein
automaton together, so that misspelled terms are caught too; a hit's weight is its term's precision, less if misspelled,
and less again if the words around it quote rather than abuse. The score is one less the product of what the
hits leave.

Copies among the labelled rows of one label count once: texts equal but for case and white space, and near copies, which the first
round of the Jaccard operator links with such a text of a smaller id.

Defined results: null or empty text scores the score of a text without hits; repeated rows score alike; rows without a label, or with a null one,
teach nothing; without labels of both classes there is no lexicon, and every text scores that of a text without hits; null ids are never held out; extra columns are ignored. Terms and stems have 3 to 40
letters, and the lexicon holds at most ``MAX_TERMS`` of them, the surest first: a bound of the model, not of the texts, which are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.common import SPACE_RUN, materialize, slices
from fusegrid.llm.ngram_join import features, tree_links

#: At most so many labelled rows are learned from, those first in the order of a hash of their ids.
SAMPLE_ROWS = 20_000
MAX_TERMS = 4000
LEAST_PRECISION = 0.5
#: A term must be so rare by chance that fewer than exp(-2) such words are expected among all words.
CHANCE = 2.0
#: Weight of a misspelling that no labelled text shows, and the least learned weight that counts as a hit.
NEAR_WEIGHT, LEAST_NEAR = 0.5, 0.35
#: Whole terms of so many letters have NEAR_WEIGHT without evidence; misspellings of shorter ones and of stems weigh what labelled texts show.
SURE_NEAR = 5
STEM_CHARS = (4, 5, 6)
#: Ends the name of a stem, which a term of letters cannot.
STEM = "*"
QUOTED_WEIGHT = 0.25
WINDOW = 6
NO_HIT = 0.01
QUOTE_CUES = frozenset("said says quote quoted quoting called word term phrase wrote".split())
#: Words are letters, with single digits among them as misspellings have.
_WORDS = re.compile(r"[^\W\d_]+(?:\d[^\W\d_]+)*")
#: Words whose weight a worker remembers.
KEPT_WORDS = 100_000
_QUOTES = "\"'“”‘’«»„"


class Trie:
    """Terms and stems, as separate ends; ``nearest`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: dict[str, tuple[float, float]]):
        """terms: text -> (precision as a whole term, precision as a stem that any ending may follow), 0 where it is not the one."""
        self.root: dict = {}
        for text, ends in terms.items():
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node["\0"] = ends
        half = lambda t: len(t) // 2
        self.heads = {t[: half(t)] for t in terms}
        self.tails = {t[half(t) :] for t, ends in terms.items() if ends[0]}
        self.head_sizes, self.tail_sizes = sorted({*map(len, self.heads)}), sorted({*map(len, self.tails)})
        self.inner = {(half(t), t[half(t) :]) for t, ends in terms.items() if ends[1]}
        self.inner_sizes = sorted({(k, len(tail)) for k, tail in self.inner})

    def exact(self, word: str) -> float:
        best, node = 0.0, self.root
        for k, c in enumerate(word, 1):
            node = node.get(c)
            if node is None:
                return best
            end = node.get("\0")
            if end is not None:
                best = max(best, end[1], end[0] if k == len(word) else 0.0)
        return best

    def nearest(self, word: str, edits: int, least: int = 3) -> Iterator[tuple[float, str]]:
        """Weight and name of each whole term of ``least`` letters within so many edits of the word, and of each such stem (its name ends with STEM)
        within so many of a beginning of the word, by stepping the automaton's state along the trie. A state has only the places that edits can reach."""
        off = edits + 1
        first = tuple(j if j >= 0 else off for j in range(-edits, edits + 1))  # places j - edits .. j + edits of the word, after j letters of the trie
        stack, n = [(self.root, first, "")], len(word)
        while stack:
            node, state, text = stack.pop()
            at = len(text) - edits
            for c, below in node.items():
                if c == "\0":
                    if len(text) >= least:
                        if below[0] and 0 <= n - at <= 2 * edits and state[n - at] <= edits:
                            yield below[0], text
                        if below[1]:
                            yield below[1], text + STEM
                    continue
                row, left = [], off
                for i in range(2 * edits + 1):
                    j = at + 1 + i
                    if j < 0 or j > n:
                        left = off
                    else:
                        above = state[i + 1] + 1 if i < 2 * edits else off
                        across = state[i] + (word[j - 1] != c) if j else off
                        left = min(above, across, left + 1, off)
                    row.append(left)
                if min(row) <= edits:
                    stack.append((below, tuple(row), text + c))

    def near(self, word: str, edits: int, least: int = 5) -> tuple[float, str]:
        """The end of the largest weight among those of ``least`` letters."""
        return max(self.nearest(word, edits, least), default=(0.0, ""))

    def may_be_near(self, word: str) -> bool:
        """Within one edit of a term, a word keeps one half of the term: at its start or at its end, or for a stem one place about where it stands in the stem."""
        if len(word) < 2:
            return False
        if any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes):
            return True
        return any((k, word[j : j + n]) in self.inner for k, n in self.inner_sizes for j in (k - 1, k, k + 1))


@dataclass
class ToxicModel:
    terms: dict[str, tuple[float, float]]
    near_weights: dict[str, float] | None = field(default_factory=dict)
    curve: list[float] | None = None
    trie: Trie | None = None
    near: Trie | None = None
    memo: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if self.trie is None:
                self.trie = Trie(self.terms)
            if len(self.memo) > KEPT_WORDS:
                self.memo.clear()
            got = self.trie.exact(word)
            if not got:
                got = max((self.near_weights.get(t, 0.0) for t in self.near_terms(word)), default=0.0)
            self.memo[word] = got
        return got

    def near_terms(self, word: str) -> list[str]:
        """The ends of the trie that a word without an exact match may misspell."""
        if self.trie is None:
            self.trie = Trie(self.terms)
        if self.trie.exact(word) or not self.near_trie().may_be_near(word):
            return []
        return [t for _, t in self.near_trie().nearest(word, 1)]

    def near_trie(self) -> Trie:
        """Only the ends whose misspellings weigh something; all of them while these weights are being learned."""
        if self.near is None:
            if self.near_weights is None:
                self.near = self.trie
            else:
                self.near = Trie({t: e for t, (whole, stem) in self.terms.items() if any(e := (whole * (t in self.near_weights), stem * (t + STEM in self.near_weights)))})
        return self.near

    def evidence(self, text: str) -> tuple[float, float, int, int]:
        """Sum and largest of the weights of the hits, each lessened by its context; different hits; words."""
        low = text.lower()
        memo, weigh = self.memo, self.word_weight
        words = _WORDS.findall(low)
        kinds = {*words}
        hits = {w for w in kinds if (memo[w] if w in memo else weigh(w))}
        total = most = 0.0
        if hits:
            for at, m in enumerate(_WORDS.finditer(low)):
                if m[0] in hits:
                    weight = weigh(m[0]) * self._context(low, m, words, at)
                    total, most = total + weight, max(most, weight)
        return total, most, len(hits), len(words)

    def score(self, text: str) -> float:
        total, most, kinds, words = self.evidence(text)
        if not kinds:
            return NO_HIT
        if self.curve is None:
            return max(NO_HIT, most)
        x = sum(c * v for c, v in zip(self.curve, _inputs(total, most, kinds, words), strict=True))
        return max(NO_HIT, 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))

    @staticmethod
    def _context(text: str, m: re.Match, words: list[str], at: int) -> float:
        around = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
        marks = any(q in around[0] for q in _QUOTES) and any(q in around[1] for q in _QUOTES)
        cue = any(w in QUOTE_CUES for w in words[max(0, at - WINDOW) : at])
        return QUOTED_WEIGHT if marks or cue else 1.0


def _inputs(total: float, most: float, kinds: int, words: int) -> tuple[float, ...]:
    return 1.0, math.log1p(total), most, math.log1p(kinds), math.log1p(words), total / math.sqrt(words + 1)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a weak pull to nought."""
    w = np.zeros(x.shape[1])
    pull = np.array([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _wilson(pos, n):
    """Lower bound of a share at about 95 %."""
    p, z = pos / n, 1.96
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _near_weights(terms: dict[str, tuple[float, float]], seen: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The weight of misspellings of each end, where it is a hit. Short terms and stems begin from what the misspellings of all ends of their
    kind and length are worth, and have none where no labelled text shows any."""
    ends = [t for t, (whole, _) in terms.items() if whole] + [t + STEM for t, (_, stem) in terms.items() if stem]
    kind = lambda t: (t.endswith(STEM), len(t))
    of_kind: dict[tuple[bool, int], tuple[int, int]] = {}
    for t, (pos, n) in seen.items():
        old = of_kind.get(kind(t), (0, 0))
        of_kind[kind(t)] = old[0] + pos, old[1] + n
    out = {}
    for t in ends:
        sure = not t.endswith(STEM) and len(t) >= SURE_NEAR
        if sure or kind(t) in of_kind:
            pos, n = (0, 0) if sure else of_kind[kind(t)]
            start = (pos + 2 * NEAR_WEIGHT) / (n + 2)
            pos, n = seen.get(t, (0, 0))
            out[t] = (pos + 2 * start) / (n + 2)
    return {t: w for t, w in out.items() if w >= LEAST_NEAR}


def without_copies(rows: DataFrame) -> DataFrame:
    """_id, _y, text: of the rows of one label that are copies, the one with the smallest id. Copies are texts equal but for case and white space, and
    near copies: texts that share minima and link as the Jaccard operator says. Rows go by their texts, so different texts of one id are no copies."""
    flat = F.trim(F.regexp_replace(F.lower("text"), SPACE_RUN, " "))
    own = materialize(rows.groupBy("_y", flat.alias("_flat")).agg(F.min(F.struct("_id", "text")).alias("_first")).select("_y", "_first.*", F.xxhash64("_y", "_flat").alias("doc_id")))
    order = own.select("doc_id", "_y", F.struct("_id", "doc_id").alias("at"))
    keys = materialize(features(own).where("n > 0").select("doc_id", "n", F.explode("bands").alias("band")).join(order, "doc_id"))
    hubs = keys.groupBy("_y", "band").agg(F.min("at").alias("hub"))
    pairs = materialize(keys.join(hubs, ["_y", "band"]).where("hub < at").select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"), "n").distinct())
    links = materialize(tree_links(own.select("doc_id", "text"), pairs))
    ends = [order.select(F.col("doc_id").alias(x), F.col("_y").alias(f"y_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab"]
    later = links.join(ends[0], "a").join(ends[1], "b").where("y_a = y_b").select(F.greatest("at_a", "at_b")["doc_id"].alias("doc_id")).distinct()
    return own.join(later, "doc_id", "left_anti").select("_id", "_y", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn from the rows of ``labels`` (those that may be learned from); at most SAMPLE_ROWS of them."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    some = F.broadcast(some.orderBy(F.xxhash64("_id"), "_y").limit(SAMPLE_ROWS))  # bounded by the limit
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(some, "_id")
    rows = materialize(rows.select("_id", "text", "_y"))
    shares = rows.agg(F.avg("_y")).first()[0]
    terms: dict[str, tuple[float, float]] = {}
    if not shares or shares >= 1:
        return ToxicModel(terms)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:\p{Nd}\p{L}+)*"), 0))
    bags = materialize(without_copies(rows).select("_y", words.alias("words")))
    shares = bags.agg(F.avg("_y")).first()[0]
    counts = materialize(bags.select("_y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("_y").alias("pos"), F.count("*").alias("n")).where("length(w) <= 40"))
    stems = counts.select("pos", "n", F.explode(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEM_CHARS])).alias("w")).where("w is not null")
    stems = stems.groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds >= 3")
    both = counts.select("w", "pos", "n", F.lit(False).alias("stem")).union(stems.select("w", "pos", "n", F.lit(True)))
    least = (math.log(max(2, counts.count())) + CHANCE) / -math.log(shares)
    both = both.where((F.col("pos") >= least) & (F.length("w") >= 3)).withColumn("sure", _wilson(F.col("pos"), F.col("n")))
    found = both.where(F.col("sure") >= LEAST_PRECISION).orderBy(F.desc("sure"), "w", "stem").limit(MAX_TERMS).collect()
    for r in found:
        weight, (whole, stem) = (r["pos"] + 0.5) / (r["n"] + 1), terms.get(r["w"], (0.0, 0.0))
        terms[r["w"]] = (whole, weight) if r["stem"] else (weight, stem)
    model = ToxicModel(terms, None)

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(t, pos, n) for w, pos, n in zip(*(batch.column(c).to_pylist() for c in ("w", "pos", "n")), strict=True) for t in model.near_terms(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["term", "pos", "n"])

    # what misspellings of each end are worth: at most two rows a term
    seen = counts.mapInArrow(near, "term string, pos long, n long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
    model = ToxicModel(terms, _near_weights(terms, {r["term"]: (r["pos"], r["n"]) for r in seen}))

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows = [_inputs(*e) + (float(y),) for e, y in ((model.evidence(t), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist(), strict=True)) if e[2]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    seen = np.array(sorted(r["x"] for r in rows.mapInArrow(weigh, "x array<double>").collect()))  # at most a row a labelled row; in order, so that runs agree
    if len(seen) >= 20 and 0 < seen[:, -1].mean() < 1:
        model.curve = _fit_curve(seen[:, :-1], seen[:, -1])
    model.trie, model.near, model.memo = None, None, {}
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double for every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            scores = [model.score(t) if t else NO_HIT for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col, folds: int, fold: int):
    """Whether the fold of a row, crc32 of its id as text, is the one that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents (all columns) whose score is below the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            keep = [(model.score(t) if t else NO_HIT) < threshold for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
