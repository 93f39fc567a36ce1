"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits or signs used as letters to plain letters,
and leaves words with one space around each. Lexicon entries are whole words or beginnings of words.
Their weights are log odds of document counts under the two labels, kept when the difference cannot
be chance; a short list of common insults has a prior weight until ``SEEN`` labelled texts hold them.
Phrases around an entry that are mostly clean in the labelled texts become exceptions, whose matches
do not count. A logistic curve over the sum of weights, plain and by text length, gives the score.

The fit reads at most ``FIT_ROWS`` labelled ids, chosen by hash of the id, so that their ids can be sent to
the texts and no text is shuffled. ``LEXICON`` bounds the lexicon and ``SAMPLE`` the texts that fit the curve
(documented parameters; chosen by evidence and by hash). Scoring reads every text whole.

Defined results: null and empty texts score as texts without a match. Rows with a null label are not
learned from. A doc_id that repeats is scored per row. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.store import stored

FIT_ROWS = 60_000
LEXICON = 20_000
SAMPLE = 20_000
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6)
#: Least G statistic and least weight of an entry.
EVIDENCE = 30.0
LEAST_WEIGHT = 2.5
PRIOR = 4.0
SEEN = 10
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "trash", "clown")

# Look-alike letters of other scripts, and digits and signs used as letters: fixed values.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ɑ": "a", "ı": "i",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}

_TABLE = {ord(a): b for a, b in _LOOKALIKES.items()}
_TABLE |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_TABLE |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_PLAIN = {chr(c): b or "" for c, b in _TABLE.items()}
#: What becomes of each byte of UTF-8: only ASCII changes, so bytes of other letters stay as they are.
_ASCII = bytearray(range(256))
for _c in range(128):
    _ASCII[_c] = ord(_DIGITS.get(chr(_c), chr(_c) if chr(_c).isalnum() else " "))
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_SIGN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])|(?<![^\s])[@$](?=[^\W_])")


def fold(text: str | None) -> str:
    """Words of plain lower-case letters with one space before and after each."""
    text = (text or "").lower()
    # A pass for each of a text's few odd letters costs less than a look-up for every letter of it.
    odd = set() if text.isascii() else {c for c in set(text) if c > "\x7f"}
    for c in odd & _PLAIN.keys():
        text = text.replace(c, _PLAIN[c])
    if any(s in text for s in _SIGNS):
        text = _SIGN.sub(lambda m: "".join(_SIGNS[c] for c in m[0]), text)
    other = [c for c in odd - _PLAIN.keys() if not c.isalnum()]
    if len(other) > 16:
        text = _OTHER.sub(" ", text)
    else:
        for c in other:
            text = text.replace(c, " ")
    text = text.encode("utf-8", "surrogatepass").translate(_ASCII).decode("utf-8", "surrogatepass")
    words = text.split()
    return f" {' '.join(words)} " if words else " "


def entries(folded: str) -> set[str]:
    """What a text could add to the lexicon: ' word ' and ' begi'."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in STEMS:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for e in entries(fold(text.as_py())):
                counts.setdefault(e, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
            ["entry", "bad", "good"],
        )


def automaton(weights: dict[str, float]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry, weight in weights.items():
        machine.add_word(entry, (entry, weight))
    if weights:
        machine.make_automaton()
    return machine


def matches(machine, folded: str):
    """(entry, weight, place of its first letter) of the heaviest entry of each word."""
    best: dict[int, tuple[str, float]] = {}
    if len(machine):
        for end, (entry, weight) in machine.iter(folded):
            at = end - len(entry) + 2
            if at not in best or weight > best[at][1]:
                best[at] = entry, weight
    return [(e, w, at) for at, (e, w) in best.items()]


def phrases(folded: str, at: int) -> tuple[str, str]:
    """The word at a place with the one before, and with the one after."""
    end = folded.index(" ", at)
    left = folded.rfind(" ", 0, max(0, at - 1))
    right = folded.find(" ", end + 1)
    word = folded[at:end]
    before = folded[left + 1 : at - 1] if left >= 0 and at > 1 else ""
    after = folded[end + 1 : right] if right > 0 else ""
    return f"{before} {word}", f"{word} {after}"


def features(machine, exceptions: frozenset, folded: str) -> tuple[float, float, int]:
    """Sum of weights, the same by length, and the number of matches that count."""
    total, n = 0.0, 0
    for _, weight, at in matches(machine, folded):
        if exceptions and any(p in exceptions for p in phrases(folded, at)):
            continue
        total += weight
        n += 1
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), math.log1p(100 * total / (words + 20)), n


class Model:
    """A lexicon, its exceptions and the curve; small, and sent to every worker."""

    def __init__(self, weights: dict[str, float], exceptions=frozenset(), curve=(-3.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.curve = weights, frozenset(exceptions), tuple(curve)

    def score(self, machine, folded: str) -> float:
        a, b, _ = features(machine, self.exceptions, folded)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _context(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(weights.value)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                folded = fold(text.as_py())
                for p in {p for _, _, at in matches(machine, folded) for p in phrases(folded, at)}:
                    counts.setdefault(p, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
                ["entry", "bad", "good"],
            )

    return run


def _measuring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        machine = automaton(own.weights)
        for batch in batches:
            found = [features(machine, own.exceptions, fold(t.as_py()))[:2] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1).cast(pa.int32())],
                ["a", "b", "toxic"],
            )

    return run


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def learn(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, toxic 0/1)."""
    spark = labelled.sparkSession
    # Written once: every pass below reads these texts, and the join that found them runs once.
    rows = stored(labelled.where("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id"), "labelled")
    bad, good = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    weights = {f" {w} ": PRIOR for w in SEEDS}
    if not bad or not good:
        return Model(weights)
    pair = rows.select("text", "toxic")
    counts = pair.mapInArrow(_counting, "entry string, bad bigint, good bigint").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    seen = F.col("bad") + F.col("good")
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    evidence = 2 * (
        part(F.col("bad"), seen * (bad / (bad + good))) + part(F.col("good"), seen * (good / (bad + good)))
    )
    counts = stored(counts.withColumn("weight", weight).withColumn("evidence", evidence), "entries")
    for r in counts.where(F.col("entry").isin(*weights) & (seen >= SEEN)).collect():
        del weights[r["entry"]]
        if r["weight"] >= LEAST_WEIGHT:
            weights[r["entry"]] = float(r["weight"])
    chosen = (
        counts.where("bad >= 3")
        .where((F.col("evidence") >= EVIDENCE) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc("evidence"), "entry").limit(LEXICON)
    )
    weights |= {r["entry"]: float(r["weight"]) for r in chosen.select("entry", "weight").collect()}
    sent = spark.sparkContext.broadcast(weights)
    context = (
        pair.mapInArrow(_context(sent), "entry string, bad bigint, good bigint")
        .groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where("good >= 3 and good >= 9 * bad")
        .orderBy(F.desc("good"), "entry").limit(LEXICON)
    )
    model = Model(weights, {r["entry"] for r in context.select("entry").collect()})
    sent = spark.sparkContext.broadcast(model)
    share = min(1.0, SAMPLE / (bad + good))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = picked.select("text", "toxic").mapInArrow(_measuring(sent), "a double, b double, toxic int").collect()
    if sample:
        x = np.array([(r[0], r[1]) for r in sample])
        model.curve = _curve(x, np.array([r[2] for r in sample], float))
    return model


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        machine = automaton(own.weights)
        for batch in batches:
            scores = [own.score(machine, fold(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scoring(sent), "doc_id bigint, score double")


def _filtering(model, at: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        machine = automaton(own.weights)
        for batch in batches:
            keep = [own.score(machine, fold(t.as_py())) < limit for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def reject(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``limit`` or more; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filtering(sent, docs.columns.index("text"), limit), docs.schema)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled ids outside the held-out fifth; an id with both labels counts as toxic."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("rows")), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
