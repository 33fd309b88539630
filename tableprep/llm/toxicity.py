"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
passages, by zstandard's own trainer. Of each class's passages those words are
blotted out that the other class has about as often; what is left is what a
class says and the other does not, besides words that occur by chance in one of
them. Behind what was trained on them both dictionaries have the same ordinary
passages, so that common words cost the same bytes with either.

A window is compressed with either dictionary. How often the toxic one saves how
many bytes in a document is calibrated to a probability on labelled documents
that no dictionary has seen, so that the threshold is 0.5. How much is trained
on either class's passages is chosen from ``SIZES`` by the likelihood of those
documents.

The dictionaries and the calibration come from a sample of labelled documents
that is bounded by ``sample`` per class, and by ``passages`` per class for the
dictionaries. Every document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, documents, map_rows, stage_table

#: Bytes saved in a window from which windows are counted.
SAVED = tuple(range(1, 11))
FEATURES = 6 + 2 * len(SAVED)
#: Bytes trained on either class's own passages, and on ordinary ones for both dictionaries.
SIZES, COMMON = (4 << 10, 8 << 10), 64 << 10
#: Bytes of the segments that are taken into a dictionary: of own words, of ordinary passages; bytes of what is counted.
SEGMENT, PASSAGE, COUNTED = 12, 64, 6
#: A word is blotted out if the other class has it at more than this part of the rate.
SHARED = 0.25
#: Signs at the ends of a word that are not part of it.
EDGES = re.compile(r"^[^\w$@#&*]+|[^\w$@#&*]+$")
WINDOW, LEVEL, LEAST_MATCH = 64, 6, 4
#: Rows that are kept or dropped at a time.
AT_ONCE = 1 << 10


@dataclass(frozen=True)
class ToxicityModel:
    """The two dictionaries and the calibration; without labels of both classes only a prior."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))


class _Savings:
    """Bytes that the toxic dictionary saves over the ordinary one."""

    def __init__(self, model: ToxicityModel) -> None:
        self.ordinary, self.toxic = (self._compress(x) for x in (model.ordinary, model.toxic))

    @staticmethod
    def _compress(content: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=2 * WINDOW, dict_size=len(content), min_match=LEAST_MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        if len(content) < 8:  # zstandard takes no shorter dictionary
            return zstandard.ZstdCompressor(compression_params=parameters).compress
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=parameters).compress

    def of(self, window: bytes) -> int:
        return len(self.ordinary(window)) - len(self.toxic(window))


_loaded: dict[tuple[bytes, bytes], _Savings] = {}


def _savings(model: ToxicityModel) -> _Savings:
    """The compressors of a task's process, made once."""
    key = (model.toxic, model.ordinary)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _Savings(model)
    return _loaded[key]


def windows(text: bytes) -> list[bytes]:
    """The whole text in lower case as pieces of ``WINDOW`` bytes or a little more, cut at blanks.

    A blank stands at either end of a piece, as at the words of a dictionary. Where
    none is near, a piece ends after four times as many bytes.
    """
    text = b" " + b" ".join(text.decode().lower().encode().split()) + b" "
    out, start, end = [], 0, len(text)
    while start < end - 1:
        stop = text.find(b" ", start + WINDOW, start + 4 * WINDOW)
        if stop < 0:
            stop = min(start + 4 * WINDOW, end - 1)
        out.append(text[start : stop + 1])
        start = stop
    return out


def features(text: bytes, savings: _Savings) -> np.ndarray:
    """The savings of a whole text as numbers of fixed count."""
    each = np.sort(np.array([savings.of(x) for x in windows(text)] or [0], float))
    root = math.sqrt(len(each))
    counts = len(each) - np.searchsorted(each, SAVED, side="left")
    return np.concatenate(
        (
            [each[-1], each[-3:].mean(), each.mean(), each.sum() / root, each.std(), math.log(len(each))],
            np.log1p(counts),
            counts / root,
        )
    )


def _words(window: bytes) -> list[str]:
    return [w for w in (EDGES.sub("", x) for x in window.decode(errors="replace").split()) if w]


def _passages(fitting: DataFrame, toxic: int, most: int) -> list[bytes]:
    """Different windows of a class's texts, at most so many, by the hash of the window."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sorted({w for t in batch.column("text").to_pylist() for w in windows(t.encode())})
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["passage"])

    rows = map_rows(fitting.where(F.col("toxic") == toxic).select("text"), cut, "passage binary").distinct()
    return rows.orderBy(F.xxhash64("passage"), "passage").limit(most).toArrow().column("passage").to_pylist()


def _own(passages: list[bytes], other: list[bytes]) -> list[bytes]:
    """The passages less the words that the other class's passages have at a like rate."""
    mine, theirs = (Counter(w for p in each for w in set(_words(p))) for each in (passages, other))
    bar = SHARED * len(other) / max(1, len(passages))
    out = []
    for passage in passages:
        words = [w for w in _words(passage) if theirs[w] < bar * mine[w]]
        if words:
            out.append(f" {' '.join(words)} ".encode())
    return out


def _trained(passages: list[bytes], size: int, segment: int) -> bytes:
    """What zstandard's trainer takes from the passages; all of them where they are too few to choose from."""
    everything = b"".join(passages)
    if len(everything) > 2 * size:
        try:
            return zstandard.train_dictionary(size, passages, k=segment, d=COUNTED).as_bytes()
        except zstandard.ZstdError:  # too few or too short
            pass
    return everything[:size]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, passages: int = 100_000, missed: float = 4.0
) -> ToxicityModel:
    """Learn from labelled documents of the training folds.

    A row of ``labels`` counts if crc32 of its ``doc_id`` as text is not
    divisible by 5. At most ``sample`` documents of each class are taken, by
    the hash of their id, and at most ``passages`` different windows of each
    for the dictionaries. Several labels of one id are toxic if one of them is;
    a null label does not count. Equal texts count once. A toxic document that
    is missed counts ``missed`` times as much as an ordinary one that is not;
    the classes otherwise weigh as they stand in ``labels``.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("dealt", F.xxhash64("doc_id"))
    )
    known = {x.toxic: x["count"] for x in rows.groupBy("toxic").count().collect()}
    ids = [rows.where(F.col("toxic") == x).orderBy("dealt", "doc_id").limit(sample) for x in (0, 1)]
    labelled = (
        documents(docs)
        .join(ids[0].union(ids[1]), "doc_id")
        .select("text", "toxic", (F.col("dealt") % 2 == 0).alias("fits"))
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"), F.min("fits").alias("fits"))
    )
    labelled = stage_table(labelled)
    fitting = labelled.where("fits")
    ordinary, toxic = (_passages(fitting, x, passages) for x in (0, 1))
    if not ordinary or not toxic:
        return _prior(labelled)
    own = _own(ordinary, toxic), _own(toxic, ordinary)
    common = _trained(ordinary, COMMON, PASSAGE)
    pairs = [[_trained(x, size, SEGMENT) + common for x in own] for size in SIZES]
    weight = missed * known[1] / known[0]
    return _calibrated(labelled, [ToxicityModel(t, o) for o, t in pairs], weight)


def _prior(labelled: DataFrame) -> ToxicityModel:
    """One class or none is labelled: every document gets the smoothed share of toxic ones."""
    n, total = labelled.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    share = (n + 0.5) / (total + 1.0) if total else 0.01
    weights = np.zeros(FEATURES + 1)
    weights[-1] = math.log(share / (1 - share))
    return ToxicityModel(weights=weights)


def _calibrated(labelled: DataFrame, models: list[ToxicityModel], weight: float) -> ToxicityModel:
    """The likeliest of the models, calibrated on rows that they were not fitted on; a prior without such rows of both classes."""
    rest = labelled.where("NOT fits")
    found = [_regression(rest, x, weight) for x in models]
    best = min((x for x in found if x), key=lambda x: x[0], default=None)
    return best[1] if best else _prior(labelled)


def _regression(labelled: DataFrame, model: ToxicityModel, weight: float) -> tuple[float, ToxicityModel] | None:
    """Loss and model of a logistic regression by Newton's method over the features of the sample.

    All toxic rows together weigh ``weight`` times as much as all ordinary ones.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        savings = _savings(model)
        found = [features(x.encode(), savings) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([list(x) for x in found], pa.list_(pa.float64()))],
            ["toxic", "features"],
        )

    rows = map_rows(labelled.select("text", "toxic"), measure, "toxic int, features array<double>").collect()
    if len({r.toxic for r in rows}) < 2:
        return None
    x, y = np.array([r.features for r in rows]), np.array([r.toxic for r in rows], float)
    v = np.where(y > 0, weight * (1 - y).sum() / y.sum(), 1.0)
    v *= len(y) / v.sum()
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = np.full(x.shape[1], 0.3)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (v * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    z = np.clip(x @ w, -30, 30)
    loss = float((v * np.logaddexp(0, np.where(y > 0, -z, z))).sum())
    return loss, ToxicityModel(model.toxic, model.ordinary, mean, scale, w)


def probabilities(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """The score of each text; a null is the empty text."""
    savings = _savings(model)
    x = np.array([features((t.as_py() or "").encode(), savings) for t in texts])
    z = (x.reshape(-1, FEATURES) - model.mean) / model.scale @ model.weights[:-1]
    return 1 / (1 + np.exp(-np.clip(z + model.weights[-1], -30, 30)))


def drop(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, all columns kept.

    Null and empty texts are scored as in ``score``; rows without an id stay or go
    by their text; an empty table gives an empty one.
    """

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probabilities(batch.column(batch.schema.get_field_index("text")), model)
        return batch.filter(pa.array(p < 0.5))

    return map_rows(docs, keep, docs.schema, AT_ONCE)


SCHEMA = "doc_id bigint, score double"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row.

    A null text is scored as the empty one. A null id keeps its row and is not
    held out. Repeated rows are scored alike. Other columns are not read. A very
    long text is scored whole, window by window. An empty table gives none.
    """
    out = arrow_schema(SCHEMA)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probabilities(batch.column("text"), model)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], schema=out)

    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return map_rows(documents(docs), measure, SCHEMA).select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
