"""Secrets in text: fixed patterns, and random-looking strings told from identifiers by two Markov models."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.llm.common import filled, passes, without

# The patterns and least lengths of the contract, in its order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the + form with 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")  # the + form with 16 characters or more
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "random")
_NAMES = re.compile("passw|secret|token|api", re.I | re.A)

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
CANDIDATE_CHARS = 20
REST_CHARS = 8
# Labelled samples: generated random strings, and names made of the most frequent words of so many documents at most.
SAMPLE_DOCUMENTS = 5000
SAMPLE_WORDS = 5000
SAMPLE_STRINGS = 4000
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789-_",
)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, 0, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i
_N = len(SYMBOLS)
# Words every model knows, so that a corpus without a sample still has a second class.
IDENTIFIERS = "configuration_file_path maximum_retry_count-default applicationContextFactory user_session_identifier".split()


@dataclass(frozen=True)
class RandomModel:
    """Log ratio of a transition under the random and the ordinary chain; ``first`` for the first character.

    ``threshold`` is the ratio a character, in nats, from which a string is taken for random.
    """

    first: np.ndarray
    step: np.ndarray
    threshold: float

    def ratio(self, text: str) -> float:
        codes = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        return float(self.first[codes[0]] + self.step[codes[:-1], codes[1:]].sum()) / len(codes)


def _counts(strings: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed counts of first characters and of pairs."""
    first, step = np.full(_N, 0.5), np.full((_N, _N), 0.2)
    for s in strings:
        codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        first[codes[0]] += 1
        np.add.at(step, (codes[:-1], codes[1:]), 1)
    return first, step


def _random_strings(draw: random.Random) -> list[str]:
    """Labelled random: every alphabet alike, also without its digits."""
    alphabets = [*ALPHABETS, *("".join(c for c in a if not c.isdigit()) for a in ALPHABETS[3:])]
    return ["".join(draw.choices(a, k=draw.randint(20, 64))) for a in alphabets for _ in range(SAMPLE_STRINGS // len(alphabets))]


def _identifiers(words: list[str], draw: random.Random) -> list[str]:
    """Labelled ordinary: names that people make of words and numbers, in the usual styles, 20 characters or more."""
    def number() -> str:
        return str(draw.randrange(10 ** draw.randint(1, 8)))

    made = []
    for _ in range(SAMPLE_STRINGS):
        style, parts, size = draw.randrange(8), [], 0
        while size < 20 or draw.random() < 0.3:
            part = number() if draw.random() < (0.9 if style == 7 else 0.15) else draw.choice(words)
            parts.append(part)
            size += len(part)
        if style == 0:
            made.append("_".join(parts))
        elif style == 1:
            made.append("-".join(parts))
        elif style == 2:
            made.append("/".join(parts))
        elif style == 3:
            made.append("".join(p.capitalize() for p in parts))
        elif style == 4:
            made.append(parts[0].lower() + "".join(p.capitalize() for p in parts[1:]))
        elif style == 5:
            made.append("_".join(parts).upper())
        elif style == 6:
            made.append("".join(parts).lower())
        else:
            made.append("-".join(parts))
    return made


def fit_random_model(ordinary: Iterable[str], threshold: float | None = None, seed: int = 7) -> RandomModel:
    """Train both chains from labelled samples: random strings over the usual alphabets, and names made of the given words.

    Without a ``threshold`` it is set from labelled strings that the chains did not see: the ratio that one in
    100 random strings falls below, or half-way from there to the one that one in 200 names exceeds if that is more.
    """
    draw = random.Random(seed)
    words = [w for w in ordinary if w] + [w for i in IDENTIFIERS for w in re.findall("[A-Z]?[a-z]+", i)]
    made, names = _random_strings(draw), _identifiers(words, draw)
    logs = [np.log(c / c.sum(axis=-1, keepdims=True)) for c in (*_counts(made), *_counts([*words, *names]))]
    model = RandomModel(logs[0] - logs[2], logs[1] - logs[3], threshold or 0.0)
    if threshold is None:
        names, made = ([model.ratio(s) for s in held] for held in (_identifiers(words, draw), _random_strings(draw)))
        low = float(np.quantile(made, 0.01))
        model = replace(model, threshold=max(low, (low + float(np.quantile(names, 0.995))) / 2))
    return model


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, sample_words: int = SAMPLE_WORDS
) -> RandomModel:
    """A model whose ordinary words are the ``sample_words`` most frequent of about ``sample_documents`` documents at most.

    The sample is a bound of the fit alone, chosen by hash of the id; scoring reads every text. What the
    fixed patterns match is no ordinary word. Words are counted in Spark.
    """
    n = docs.count()
    share = 1.0 if n <= sample_documents else sample_documents / n
    texts = docs.select(F.col(text_col).alias("text")).where(
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            counts: Counter[str] = Counter()
            for text in filled(batch.column(0)).to_pylist():
                text = HEX.sub(" ", ACCESS.sub(" ", ASSIGN.sub(" ", text)))
                counts.update(re.findall(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{1,15}(?![A-Za-z0-9])", text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return fit_random_model([r.word for r in found.orderBy(F.desc("n"), "word").limit(sample_words).collect()])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches that are long enough, ordered."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]], model: RandomModel) -> list[tuple[int, int, int]]:
    """The base spans, and what the model takes for random of the candidates.

    Only a candidate's parts outside base spans are looked at: of an access key, a slash and a
    random rest the rest is one more span. A part is scored if it has ``CANDIDATE_CHARS``; beside a
    base span shorter parts (``REST_CHARS``) are too, as the whole of them is likely one secret.
    """
    more = []
    for m in CANDIDATE.finditer(text):
        parts, at = [], m.start()
        touching = [(s, e) for s, _, e in base if s < m.end() and m.start() < e]
        for s, e in touching:
            parts.append((at, s))
            at = max(at, e)
        parts.append((at, m.end()))
        for begin, end in parts:
            word = text[begin:end].strip("=-_/+") if begin < end else ""
            if len(word) < (REST_CHARS if touching else CANDIDATE_CHARS):
                continue
            begin = text.index(word, begin)
            if model.ratio(word) >= model.threshold:
                more.append((begin, 3, begin + len(word)))
    return sorted(base + more) if more else base


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: RandomModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts per kind, ``base_sha256`` and ``spans``.

    Spans are those of whole matches, in code points, end exclusive. A null text is an empty one and has
    no spans. Equal rows give equal rows; nulls in the id stay. Other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            rows = []
            for text in filled(batch.column(1)).to_pylist():
                base = base_spans(text)
                spans = all_spans(text, base, model)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for name in names[1:]:
        schema = schema.add(name, T.LongType() if name.startswith("n_") else T.StringType())
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: RandomModel, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, and ``n_secrets``. A null text becomes empty."""
    docs = without(docs, "n_secrets")
    columns = [*docs.columns, "n_secrets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, text_col):
            texts, counts = [], []
            for text in filled(batch.column(text_col)).to_pylist():
                merged: list[list[int]] = []
                for start, _, end in all_spans(text, base_spans(text), model):
                    if merged and start < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                for start, end in reversed(merged):
                    text = text[:start] + mark + text[end:]
                texts.append(text)
                counts.append(len(merged))
            own = {text_col: pa.array(texts, pa.string()), "n_secrets": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], columns)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("n_secrets", T.LongType())]))
