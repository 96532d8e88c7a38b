"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic text. A text is cut into windows of
``WINDOW`` words, and the lengths that each window has without a dictionary, with the toxic one, with the ordinary one and
with both are compared: what the toxic dictionary saves on its own, and what it saves beyond the ordinary one. Largest
saving, sum and mean of a whole text's windows become a probability by a logistic calibration on labelled texts that
trained no dictionary.

Toxic texts are mostly ordinary prose, and short windows save whole bytes only, so a dictionary of all their words tells
little. The toxic one is trained on beginnings of words that significantly more toxic than ordinary texts hold.

Everything is fitted on a bounded sample: at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` labelled rows, the first in the
order of a hash of their id, and for the dictionaries ``SAMPLE_WINDOWS`` windows of each, chosen by a hash from anywhere
in the text. Calibration and scoring read whole texts, on executors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import scanned, words_of, written

SAMPLE_TOXIC, SAMPLE_ORDINARY = 2_500, 5_000
#: Windows of a sample text that train, of ``SAMPLE_WINDOW`` words each; words of ordinary text that train.
SAMPLE_WINDOWS, SAMPLE_WINDOW, SAMPLE_WORDS = 20, 24, 400_000
#: Words of a window that is scored.
WINDOW = 8
TOXIC_BYTES, ORDINARY_BYTES = 2_048, 65_536
#: Bytes of a word's beginning, with the blank before it; shorter words count with the blank behind them.
STEM = range(5, 10)
#: A beginning is toxic text's own if relatively that many times more toxic texts hold it than ordinary ones, with
#: chance below exp(-OWN_ODDS).
OWN_TIMES, OWN_ODDS = 10, 14
#: One sample text in so many calibrates instead of training; texts that begin alike are on the same side.
CALIBRATE, ALIKE = 4, 8

SCORES = "doc_id long, held_out boolean, score double"


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    for i in range(0, len(words), size):
        yield b" " + b" ".join(words[i : i + size]) + b" "


def _stems(word: bytes) -> list[bytes]:
    """Beginnings of a word, the longest first."""
    whole = b" " + word + b" "
    return [whole[:n] for n in reversed(STEM) if n <= len(whole)]


def _is_own(n: int, m: int, toxic: int, plain: int) -> bool:
    """Whether n toxic and m ordinary texts with a beginning are far from chance, by the Chernoff bound."""
    if n / toxic <= OWN_TIMES * (m + 0.5) / plain:
        return False
    chance, share = toxic / (toxic + plain), n / (n + m)
    if share <= chance:
        return False
    odds = share * np.log(share / chance) + (0 if m == 0 else (1 - share) * np.log((1 - share) / (1 - chance)))
    return (n + m) * odds >= OWN_ODDS


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; where they are too few to train on, the distinct samples themselves."""
    import zstandard

    joined = [b"".join(samples[i : i + 4]) for i in range(0, len(samples), 4)]
    try:
        return zstandard.train_dictionary(size, joined).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Dictionaries and calibration; small, so it travels with the tasks."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()

    @cached_property
    def lengths(self):
        """Functions that give a window's compressed length: without a dictionary, with the toxic one, the ordinary one, both."""
        import zstandard as z

        setup = z.ZstdCompressionParameters.from_level(
            3, window_log=17, min_match=6, strategy=z.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        made = [z.ZstdCompressor(compression_params=setup)]
        for content in (self.toxic, self.ordinary, self.toxic + self.ordinary):
            data = z.ZstdCompressionDict(content or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=setup)
            made.append(z.ZstdCompressor(compression_params=setup, dict_data=data))
        return [lambda w, c=c.compress: len(c(w)) for c in made]

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights}

    def features(self, text: str) -> np.ndarray:
        plain, toxic, ordinary, both = self.lengths
        n, alone, beyond = 0, [0], [0]
        for w in windows(words_of(text)):
            n += 1
            alone.append(max(plain(w) - toxic(w), 0))
            beyond.append(max(ordinary(w) - both(w), 0))
        out = [1.0, np.log1p(n)]
        for saved in (alone, beyond):
            out += [max(saved), np.log1p(sum(saved)), sum(saved) / max(n, 1)]
        return np.array(out)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ np.array(self.weights), -30, 30))))


def _calibrated(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a ridge on the standardised features, by Newton steps."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[0], spread = 0, np.where(spread > 0, spread, 1)
    x = (features - mean) / spread
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge @ w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), gradient)
    w = w / spread
    w[0] -= w @ mean
    return tuple(w.tolist())


def sample_of(text: str) -> tuple[bytes, bool, bytes]:
    """(beginning, whether it calibrates, words of the windows that train) of a sample text."""
    words = words_of(text)
    start = b" ".join(words[:ALIKE])
    chosen = sorted(windows(words, SAMPLE_WINDOW), key=lambda w: (zlib.crc32(w), w))[:SAMPLE_WINDOWS]
    return start, zlib.crc32(start) % CALIBRATE == 0, b"".join(chosen)


def train(toxic: list[bytes], plain: list[bytes]) -> Model:
    """Dictionaries from the words of toxic and of ordinary texts; a side without texts leaves both empty."""
    if not toxic or not plain:
        return Model(b"", b"")
    in_toxic = Counter(s for t in toxic for s in {s for w in set(t.split()) for s in _stems(w)})
    in_toxic = {s: n for s, n in in_toxic.items() if n > 1 or len(toxic) < 4}
    in_plain = Counter(s for t in plain for s in {s for w in set(t.split()) for s in _stems(w) if s in in_toxic})
    own = {s for s, n in in_toxic.items() if _is_own(n, in_plain[s], len(toxic), len(plain))}
    marks = [next(filter(own.__contains__, _stems(w)), b"") for t in toxic for w in dict.fromkeys(t.split())]
    marks = [m for m in marks if m]  # the longest own beginning of each word
    words = list(islice((b" " + w + b" " for t in plain for w in t.split()), SAMPLE_WORDS))
    return Model(_dictionary(marks, TOXIC_BYTES), _dictionary(words, ORDINARY_BYTES))


def held_out(doc_id: str = "doc_id"):
    """Rows that never train: crc32 of the id as text (null: empty) is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample, (_id, _toxic, text): ids are chosen first; texts are whole."""
    marks = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = marks.filter("_toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(marks.filter("_toxic = 0").orderBy(*order).limit(SAMPLE_ORDINARY))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"])
    return joined.groupBy("_id", "_toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the sample; without examples of both kinds for training and calibration every score is 0."""
    rows = written(sample_rows(docs, labels), "toxicity-sample")

    def pieces(batches):
        for batch in batches:
            found = list(zip(*map(sample_of, batch.column(2).to_pylist()), strict=True)) or [[], [], []]
            columns = [pa.array(c, k) for c, k in zip(found, (pa.binary(), pa.bool_(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_id", "_toxic", "start", "calibrates", "words"])

    kinds = f"_id {rows.schema['_id'].dataType.simpleString()}, _toxic int"
    sample = written(scanned(rows, pieces, kinds + ", start binary, calibrates boolean, words binary"), "toxicity-words")
    # texts of one kind that begin alike are copies; texts without words teach nothing
    single = sample.filter(F.length("start") > 0).groupBy("start", "_toxic", "calibrates").agg(F.min(F.struct("_id", "words")).alias("first"))
    trains = single.filter("not calibrates").select("_toxic", "first.*").orderBy("_id").select("_toxic", "words").collect()
    model = train(*([bytes(r["words"]) for r in trains if r["_toxic"] == y] for y in (1, 0)))
    held = rows.join(F.broadcast(single.filter("calibrates").select(F.col("first._id").alias("_id"))), "_id", "left_semi").select("_id", "_toxic", "text")

    def measured(batches):
        for batch in batches:
            values = pa.array([model.features(t).tolist() for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["_id", "_toxic", "features"])

    if not model.toxic:
        return model
    found = scanned(held, measured, kinds + ", features array<double>").orderBy("_id").collect()
    if len({r["_toxic"] for r in found}) < 2:
        return Model(b"", b"")
    return replace(model, weights=_calibrated(np.array([r["features"] for r in found]), np.array([r["_toxic"] for r in found], float)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; the text is the only input of a score.

    A null text is empty and scores like one; very long texts are scored whole; repeated rows get a score each; a null id counts as held out;
    an empty table gives no rows; other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            scores = pa.array([model.score(t or "") for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return scanned(rows, scan, SCORES).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below one half, with the columns of ``docs``."""
    place = docs.columns.index("text")

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))

    return scanned(docs, clean, docs.schema)
