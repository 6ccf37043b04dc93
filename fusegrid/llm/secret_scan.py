"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over characters are trained from labelled samples; a run of secret-like characters outside
the pattern spans is a secret if its log-likelihood ratio per character passes the threshold. Candidates are runs of CANDIDATE_LEAST characters at
least: in fewer, a ratio a character does not tell keys from names. Runs without a digit have two models of their own, of random letters against
words joined as identifiers and paths are, and a threshold that LETTERS_PASS of these labelled identifiers pass. Runs of digits only are no
candidates: characters do not tell random digits from numbers.

Defined results: null text counts as empty and has no spans; spans are code points, end exclusive, by start and then
kind in the order of KINDS; repeated rows are scanned each; null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
BASE_KINDS = KINDS[:3]
# Fixed values of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

CANDIDATE_LEAST = 16
THRESHOLD = 0.25
SAMPLE_DOCS = 2000
SAMPLE_WORDS = 20_000
#: So many of the values that patterns mark are learned from, those first in the order of a hash.
SAMPLE_MARKED = 1000
#: The largest share of labelled identifiers without a digit that may pass the threshold of such runs.
LETTERS_PASS = 0.0002
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_MARKS = re.compile(r"[+/_=-]+")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{CANDIDATE_LEAST},}}={{0,2}}")


@dataclass
class MarkovModel:
    """Log-likelihood ratio of each character after another (or the start, key '')."""

    ratio: dict[tuple[str, str], float]
    unseen: float
    #: Of runs without a digit; None where no labelled words make one.
    letters: MarkovModel | None = None
    letters_threshold: float = math.inf

    @staticmethod
    def train(samples: list[tuple[str, bool]], smooth: float = 0.2) -> MarkovModel:
        """samples: a string and whether it is a secret. The ordinary ones without a digit also make the model of runs without one."""
        model = MarkovModel._fit(samples, smooth)
        ordinary = identifiers([t for t, secret in samples if not secret and len(_plain(t)) >= 6 and not any(map(str.isdigit, t))])
        if ordinary:
            rules = [c * 24 for c in ALPHABET[:52]]
            model.letters = MarkovModel._fit([(t, False) for t in ordinary + rules] + [(t, True) for t in random_letters()], smooth)
            scores = sorted((model.letters.score(t) for t in ordinary + rules), reverse=True)
            model.letters_threshold = max(THRESHOLD, scores[int(LETTERS_PASS * len(scores))])
        return model

    @staticmethod
    def _fit(samples: list[tuple[str, bool]], smooth: float) -> MarkovModel:
        counts: dict[bool, dict] = {True: {}, False: {}}
        rows: dict[bool, dict] = {True: {}, False: {}}
        for text, secret in samples:
            before = ""
            for c in text:
                counts[secret][before, c] = counts[secret].get((before, c), 0) + 1
                rows[secret][before] = rows[secret].get(before, 0) + 1
                before = c
        n = len(ALPHABET)
        log = lambda s, a, c: math.log((counts[s].get((a, c), 0) + smooth) / (rows[s].get(a, 0) + smooth * n))
        return MarkovModel({(a, c): log(True, a, c) - log(False, a, c) for a in ["", *ALPHABET] for c in ALPHABET}, 0.0)

    def score(self, text: str) -> float:
        """Log-likelihood ratio per character; above 0 a random string is likelier."""
        return sum(self.ratio.get(p, self.unseen) for p in zip(["", *text], text, strict=False)) / max(1, len(text))


def _plain(run: str) -> str:
    """A run without a digit, its marks of any number and kind as one hyphen between names."""
    return _MARKS.sub("-", run).strip("-")


def identifiers(words: list[str]) -> list[str]:
    """Ordinary words in twos to fives, of CANDIDATE_LEAST characters at least, joined as names and paths are; each word begins one of each form."""
    out, n = [], len(words)
    for i in range(n):
        text, k = _plain(words[i]), 1
        several = [text]
        while k < 5 and (k < 2 or sum(map(len, several)) < CANDIDATE_LEAST):
            several.append(_plain(words[(i + k) % n]))
            k += 1
        joined = "-".join(several)
        out += [t for t in (joined, joined.upper(), several[0] + "".join(w[:1].upper() + w[1:] for w in several[1:])) if len(t) >= CANDIDATE_LEAST]
    return out


def random_letters(n: int = 6000) -> list[str]:
    """Secrets without a digit from a fixed seed: letters of both cases, small ones, capitals."""
    import random

    r = random.Random(12)
    kinds = [ALPHABET[:52], ALPHABET[26:52], ALPHABET[:26]]
    return ["".join(r.choice(kinds[i % 3]) for _ in range(r.randint(16, 48))) for i in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), leftmost non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]  # runs are maximal, so none that fails hides another
    return sorted(out)


def spans_of(text: str, model: MarkovModel, threshold: float = THRESHOLD) -> list[dict]:
    base = base_spans(text)
    found = [(s, k, e, None) for s, k, e in base]
    for m in _RUN.finditer(text):
        s, e = m.span()
        run = m[0]
        if any(a < e and s < b for a, _, b in base) or run.isdigit():
            continue  # a run of digits only is a number
        if any(map(str.isdigit, run)):
            score, least = model.score(run), threshold
        elif model.letters is not None and len(plain := _plain(run)) >= CANDIDATE_LEAST:
            score, least = model.letters.score(plain), max(threshold, model.letters_threshold)
        else:
            continue
        if score > least:
            found.append((s, 3, e, score))
    return [{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(found, key=lambda x: x[:3])]


def random_strings(n: int = 4000) -> list[str]:
    """Secrets of common forms from a fixed seed: base64, letters and digits, hexadecimal, capitals and digits."""
    import random

    r = random.Random(11)
    kinds = [ALPHABET[:64], ALPHABET[:62], "0123456789abcdef", ALPHABET[:26] + "0123456789"]
    return ["".join(r.choice(kinds[i % 4]) for _ in range(r.randint(16, 48))) for i in range(n)]


def labelled_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[tuple[str, bool]]:
    """Ordinary identifiers from the words of the documents of at most SAMPLE_DOCS ids (SAMPLE_WORDS of them), secrets of fixed forms, and the
    values that the patterns mark in those documents. The bounds are the sample's; scanning has none."""
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ids are ordered without their texts; the limit bounds the broadcast
    some = rows.join(F.broadcast(rows.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)), "h", "left_semi")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[\s(,])([A-Za-z][A-Za-z_-]{5,})(?=[\s,.;)]|$)"), 1)).alias("w")).distinct()
    ordinary = [r["w"] for r in words.orderBy(F.xxhash64("w")).limit(SAMPLE_WORDS).collect()]
    marked = some.select(F.explode(F.regexp_extract_all("text", F.lit(rf"([0-9a-f]{{{HEX_LEAST},64}}|AKIA[A-Z0-9]{{16,}})"), 1)).alias("w")).distinct()
    secrets = [r["w"] for r in marked.orderBy(F.xxhash64("w"), "w").limit(SAMPLE_MARKED).collect()]
    plain = ["transaction", "application_context", "get_user_name", "document-identifier", "maximumPartitionBytes", "configuration"]
    return [(w, False) for w in ordinary + plain * 20] + [(w, True) for w in secrets + random_strings()]


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>> for every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            spans = [spans_of(t, model, threshold) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select("doc_id", *map(count, BASE_KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
