"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import filled, passes

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.5
# The fit reads about so many labelled rows of each language at most, chosen by hash; scoring reads every row.
SAMPLE_ROWS = 5000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLDS: list[np.ndarray] = []
_SEPARATOR = 32


def has_letter(text: str) -> bool:
    """Whether a code point of the text is a letter by its Unicode category."""
    return bool((m := _LETTER.search(text)) and (m[0].isalpha() or any(map(str.isalpha, text))))


def _fold() -> np.ndarray:
    """Every code point as itself if it is a letter or a mark, else as the separator; made once in a process."""
    if not _FOLDS:
        table = np.arange(0x110000, dtype=np.uint32)
        table[[unicodedata.category(chr(c))[0] not in "LM" for c in range(0x110000)]] = _SEPARATOR
        _FOLDS.append(table)
    return _FOLDS[0]


def ngrams(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all texts in a row, and the offset of each text's n-grams.

    Characters are code points, lower-cased by Python so that accented capitals fold as well. A run of
    anything but letters and marks is one separator. Separators alone are left out, and no n-gram spans two texts.
    """
    texts = [t.lower() for t in filled(column).to_pylist()]
    points = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    keep = points != _SEPARATOR
    keep[1:] |= keep[:-1]  # the first separator of a run
    keep[offsets[:-1][offsets[:-1] < len(points)]] = True
    offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
    points = points[keep].astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    code = np.zeros(len(points), np.uint64)
    found, owner = [], []
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        code = (code[:n] + points[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        at = np.flatnonzero(np.arange(n) + order <= ends[:n] if order > 1 else points != _SEPARATOR)
        found.append((code[at] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - buckets.bit_length())).astype(np.uint32))
        owner.append(np.searchsorted(at, offsets))
    counts = sum(np.diff(o) for o in owner)
    out = np.empty(int(counts.sum()), np.uint32)
    before = np.concatenate([[0], np.cumsum(counts)])
    begin = before[:-1].copy()
    for hashes, o in zip(found, owner):
        sizes = np.diff(o)
        out[np.repeat(begin - o[:-1], sizes) + np.arange(len(hashes))] = hashes
        begin += sizes
    return out, before


@dataclass(frozen=True)
class Model:
    """Languages in order, log priors, and log probabilities (bucket, language)."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", by: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Count n-grams per language over about ``sample_rows`` labelled rows of each at most, chosen by a hash of ``by`` (without it: of the text).

    Rows without a text or a language teach nothing; a rare language is learned from all its rows. The priors
    are shares of all labelled rows. At most languages x buckets counts come back to the driver.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    numbers = {str(lang): n for lang, n in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if any(n > sample_rows for n in numbers.values()):
        limits = F.create_map(*[F.lit(x) for lang, n in numbers.items() for x in (lang, int(min(1.0, sample_rows / n) * (1 << 30)))])
        own = F.col(text_col) if by is None else F.coalesce(by.cast("string"), F.col(text_col))
        rows = rows.where(F.pmod(F.xxhash64(own), F.lit(1 << 30)) < F.element_at(limits, F.col(lang_col).cast("string")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in passes(batches, "text"):
            grams, at = ngrams(batch.column(0))
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                of = np.flatnonzero(np.repeat([x == lang for x in langs], np.diff(at)))
                totals[lang] = totals.get(lang, 0) + np.bincount(grams[of], minlength=BUCKETS)
        for lang, total in totals.items():
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(total[held].astype(np.int64)),
            ], ["lang", "bucket", "n"])

    counts = (
        rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(numbers)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    prior = np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
        prior[k] += numbers[lang]
    return Model(languages, np.log(prior / prior.sum()), np.log(table / table.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior probability of that language) and ``evidence``.

    ``evidence`` is how much likelier its n-grams are in that language than by chance: the mean of their log
    probabilities less that of one bucket among all. It is null where ``lang_pred`` is ``und``.

    ``und`` with score 0: the text is null or has no letter, or the model knows no language. Of equally
    likely languages the first by name is taken. All rows and other columns stay; columns of these three
    names are replaced. The table is bounded by languages x buckets and is sent to each executor once.
    """
    taken = {"lang_pred", "score", "evidence"}
    columns = [c for c in docs.columns if c.lower() not in taken]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, text_col):
            text = batch.column(text_col)
            known = [bool(shared.value.languages) and has_letter(t) for t in filled(text).to_pylist()]
            lang, score, evidence = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            if any(known):
                grams, at = ngrams(text)
                total = np.empty((len(batch), len(shared.value.languages)))
                for k in range(len(shared.value.languages)):
                    sums = np.concatenate([[0.0], np.cumsum(shared.value.table[grams, k], dtype=np.float64)])
                    total[:, k] = shared.value.prior[k] + sums[at[1:]] - sums[at[:-1]]
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                mean = (total - shared.value.prior)[np.arange(len(batch)), best] / np.maximum(np.diff(at), 1)
                evidence = mean + np.log(BUCKETS)
                lang = [shared.value.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.array(evidence, pa.float64(), mask=~np.array(known, bool)),
                ],
                [*columns, "lang_pred", "score", "evidence"],
            )

    schema = T.StructType([docs.schema[c] for c in columns]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("evidence", T.DoubleType())
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
