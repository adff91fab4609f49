"""Language identification as inference of a multilingual mixture.

A character n-gram model gives every word a likelihood in each language (n-grams of one to
three letters, interpolated). A document is a mixture of languages: expectation-maximisation
finds the proportions from its words' likelihoods. The set of languages grows greedily, as
long as the log-likelihood gains more than a penalty of `penalty` * ln(words) per language.

Training reads labelled rows only, at most `SAMPLE_PER_LANGUAGE` of each language (those with
the least hash of key and text; rows without a key, and texts over
`SAMPLE_CHARS` characters, teach nothing); these bounds are parameters. Prediction reads nothing but the
text. Null texts and texts without a letter are `und` with score 0; with no labelled rows, so
is every text. Words are maximal runs of letters, lower-cased; very long texts are worked
through in blocks. Ties go to the first language by name. Repeated rows stay, an empty table
gives an empty one, and only the named columns are read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.llm.common import released, unused

SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 50_000
BUCKETS = 1 << 17
WEIGHTS = (0.1, 0.3, 0.6)
PENALTY = 3.0
ROUNDS = 25
BLOCK_CHARS = 1 << 20
RESULTS = ("lang_pred", "score", "proportions")

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that ends at each letter (blanks stand before words), and where words begin among them."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[cp]
    padded = np.zeros(len(cp) + 2, np.uint64)
    padded[2:] = np.where(is_letter, cp, 0)
    at = np.flatnonzero(is_letter)
    one, two, three = padded[at + 2], padded[at + 1], padded[at]
    three = np.where(two == 0, 0, three)
    mask = np.uint64(BUCKETS - 1)
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask
    a = one + np.uint64(1 << 60)
    b = (two << np.uint64(21)) + one + np.uint64(2 << 60)
    c = (three << np.uint64(42)) + (two << np.uint64(21)) + one
    begins = np.flatnonzero(np.diff(at, prepend=-9) > 1)
    return [mix(a), mix(b), mix(c)], begins


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Pieces of a text that end outside words where a blank lets them."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = text.rfind(" ", start + 1, end)
            end = cut if cut > start else end
        yield text[start:end]
        start = end


class Mixture:
    """languages: names; table: per n-gram order, bucket and language, the log probability of the n-gram."""

    def __init__(self, languages: list[str], counts: list[np.ndarray], penalty: float = PENALTY):
        self.languages, self.penalty = languages, penalty
        # a word's likelihood is the product over its letters of the interpolated n-gram shares
        self.share = [((c + 0.05) / (c.sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32) * np.float32(w) for c, w in zip(counts, WEIGHTS)]

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], penalty: float = PENALTY) -> "Mixture":
        languages = sorted({lang for _, lang in rows})
        place = {x: i for i, x in enumerate(languages)}
        counts = [np.zeros((BUCKETS, len(languages)), np.float64) for _ in WEIGHTS]
        for text, lang in rows:
            for block in blocks(text):
                for order, g in enumerate(grams(block)[0]):
                    counts[order][:, place[lang]] += np.bincount(g, minlength=BUCKETS)
        # every language gets the same weight, whatever its sample's size
        counts = [c / np.maximum(c.sum(axis=0), 1) * 1e6 for c in counts]
        return cls(languages, counts, penalty)

    def word_likelihoods(self, text: str) -> np.ndarray:
        """ln P(word | language), words x languages."""
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for block in blocks(text):
            (a, b, c), begins = grams(block)
            if len(begins):
                out.append(np.add.reduceat(np.log(self.share[0][a] + self.share[1][b] + self.share[2][c]), begins, axis=0))
        return np.concatenate(out)

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions of the chosen set). The score is the language's share, times its posterior when it stands alone."""
        words = self.word_likelihoods(text) if text and self.languages else np.zeros((0, 0))
        if not len(words):
            return "und", 0.0, {}
        alone = words.sum(axis=0, dtype=np.float64)
        chosen, value, shares = [int(np.argmax(alone))], float(alone.max()), np.ones(1)
        top = words.max(axis=1, keepdims=True)
        p = np.exp(words - top)
        base, cost = float(top.sum(dtype=np.float64)), self.penalty * np.log(1 + len(words))
        while len(chosen) < len(self.languages):
            best = None
            now = p[:, chosen] @ shares
            for k in sorted(set(range(len(self.languages))) - set(chosen)):
                # no mixture with k gains more than each word by itself would
                if np.log(np.maximum(p[:, k], now) / now).sum() <= cost:
                    continue
                s, v = self._proportions(p[:, [*chosen, k]], base)
                if best is None or v > best[1]:
                    best = k, v, s
            if best is None or best[1] - value <= cost:
                break
            chosen, value, shares = [*chosen, best[0]], best[1], best[2]
        i = int(np.argmax(shares))
        score = float(shares[i])
        if len(chosen) == 1:
            score = float(1 / np.exp(np.clip(alone - alone[chosen[0]], -700, 0)).sum())
        return self.languages[chosen[i]], min(1.0, max(0.0, score)), {self.languages[c]: float(s) for c, s in zip(chosen, shares)}

    @staticmethod
    def _proportions(p: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        s = np.full(p.shape[1], 1 / p.shape[1])
        p = np.maximum(p, 1e-300)
        for _ in range(ROUNDS):
            r = p * s
            total = r.sum(axis=1, keepdims=True)
            new = (r / total).mean(axis=0)
            if np.abs(new - s).max() < 1e-4:
                s = new
                break
            s = new
        return s, base + float(np.log(p @ s).sum())


def sample(df: DataFrame, text: str, label: str, key: str, use: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most `per_language` labelled texts of each language: those with the least hash of key and text. Rows equal in both teach once.

    The first pass tells how many hashes a language has and its least one; the second reads the rows
    below a bound that lets through little more than is wanted, and always the least. No language
    is lost, and no task ranks a whole one, however often a key or a text is repeated.
    """
    rows = df.where(use & F.col(label).isNotNull() & (F.length(text) <= SAMPLE_CHARS) & F.col(key).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("l"), F.xxhash64(F.lit(11), F.col(key), F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))
    found = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least")).collect()
    if not found:
        return []
    # hashes run from -2**63; 1.25 covers the estimate's error
    share = lambda n: min(1.0, (1.25 * per_language + 50) / max(1, n))
    most = F.create_map(*(F.lit(x) for r in found for x in (r["l"], max(r["least"], min((1 << 63) - 1, int(share(r["n"]) * (1 << 64)) - (1 << 63))))))
    once = rows.where(F.col("h") <= most[F.col("l")]).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("l").orderBy("h")
    chosen = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    return [(r["t"], r["l"]) for r in sorted(chosen.select("l", "n", "t").collect(), key=lambda r: (r["l"], r["n"]))]


def identify(df: DataFrame, model: Mixture, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (without those named like a result, which replaces them) and lang_pred, score, proportions (map).

    No shuffle; the model goes out as one broadcast of a size fixed by BUCKETS and the number of languages.
    """
    keep = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c.lower() not in RESULTS]
    fields = df.select(*keep).schema.fields
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, proportions map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                got = [m.infer(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(fields))), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([list(x[2].items()) for x in got], pa.map_(pa.string(), pa.float64()))], names=[*(f.name for f in fields), *RESULTS])

    return df.select(*keep, F.col(text).cast("string").alias(unused("text", [f.name for f in fields]))).mapInArrow(released(run), schema)


def held_out(key: str = "doc_id") -> Column:
    """True for the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, penalty: float = PENALTY) -> Mixture:
    return Mixture.fit(sample(df, text, label, key, ~held_out(key), per_language), penalty)
