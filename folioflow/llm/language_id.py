"""Language identification: known words first, then shorter and shorter character n-grams.

A word seen in training adds its log frequency in every language. An unseen word is taken apart: the longest n-grams
(with the word's edges marked) of which any is known speak for it, so endings and letter pairs decide where whole
words cannot. Counts come from Spark; the model is a table of bounded size, sent out once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import written

#: Bounds of the model: labelled rows per language that train it (about; chosen by a hash), words and n-grams of each order kept per language (commonest first).
ROWS, WORDS, GRAMS = 4_000, 50_000, 20_000
#: Orders of character n-grams, in the order of the fall-back; count that an unseen word or n-gram gets.
ORDERS, UNSEEN = (5, 4, 3, 2, 1), 0.5
#: Unseen words a worker remembers.
MEMO = 500_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """The word's n-grams with its edges marked; none if it is too short."""
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class LanguageModel:
    """Rows of log frequencies by word and by n-gram; column k belongs to ``langs[k]``."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    logs: np.ndarray
    memo: dict[str, list[int]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def backed_off(self, word: str) -> list[int]:
        """The rows that speak for an unseen word: its known n-grams of the longest order that has any."""
        for order in ORDERS:
            table = self.grams[order]
            known = [k for g in grams_of(word, order) if (k := table.get(g)) is not None]
            if known:
                return known
        return []

    def totals(self, text: str) -> np.ndarray:
        """Log likelihood of each language over all words; the n-grams of an unseen word count as their mean."""
        rows, parts = [], []
        for word, n in Counter(words_of(text)).items():
            known = self.words.get(word)
            if known is not None:
                rows.append(known)
                parts.append(n)
                continue
            found = self.memo.get(word)
            if found is None:
                found = self.backed_off(word)
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                if len(word) <= 64:
                    self.memo[word] = found
            rows += found
            parts += [n / len(found)] * len(found) if found else []
        return np.array(parts, np.float64) @ self.logs[rows] if rows else np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its probability); ties go to the first language, texts without a letter are undetermined."""
        if not self.langs or not text or not _WORD.search(text):
            return UNDETERMINED, 0.0
        total = self.totals(text)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _logs(counts: dict[str, dict[str, int]], langs: list[str]) -> np.ndarray:
    """One row per item in order: its smoothed log frequency in each language."""
    place = {lang: k for k, lang in enumerate(langs)}
    table = np.full((len(counts), len(langs)), UNSEEN)
    for row, of in enumerate(counts.values()):
        for lang, n in of.items():
            table[row, place[lang]] += n
    return np.log(table / (table.sum(axis=0) + UNSEEN))


def _batch(counts: dict[tuple, Counter], names: list[str]) -> pa.RecordBatch:
    """One row per key of ``counts`` and item."""
    sizes = [len(c) for c in counts.values()]
    columns = []
    for i, name in enumerate(names[:-2]):
        keys = pa.array([k[i] for k in counts], pa.int32() if name == "size" else pa.string())
        columns.append(keys.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
    items = pa.array([x for c in counts.values() for x in c], pa.string())
    return pa.RecordBatch.from_arrays([*columns, items, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=names)


def _word_counts(batches):
    """(lang, item, count) of a shard's words."""
    for batch in batches:
        found: defaultdict = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found[lang,].update(words_of(text.as_py()))
        yield _batch(found, ["lang", "item", "count"])


def _gram_counts(batches):
    """(lang, size, item, count): n-grams of distinct words, as unseen words are made of them."""
    for batch in batches:
        found: defaultdict = defaultdict(Counter)
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for order in ORDERS:
                found[lang, order].update(grams_of(word, order))
        yield _batch(found, ["lang", "size", "item", "count"])


def fit(docs: DataFrame, trains: Column, rows: int = ROWS, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """A model from the rows of ``docs`` (text, lang, columns that ``trains`` names) where ``trains`` holds and text and lang are not null.

    Of each language about ``rows`` rows are used, chosen by a hash of row content, and their whole texts counted; the model keeps ``words``
    words and ``grams`` n-grams of each order per language. Without such rows it knows no language.
    """
    labelled = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    # one entry per language: these are the model's columns
    shares = [F.lit(x) for r in labelled.groupBy("lang").count().collect() for x in (r["lang"], rows / r["count"])]
    if not shares:
        return LanguageModel([], {}, {order: {} for order in ORDERS}, np.zeros((0, 0)))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.filter(chance < F.create_map(*shares)[F.col("lang")])
    seen = sample.mapInArrow(_word_counts, "lang string, item string, count long").groupBy("lang", "item").agg(F.sum("count").alias("count"))
    seen = written(seen, "language-words")
    parts = seen.select("lang", "item").mapInArrow(_gram_counts, "lang string, size int, item string, count long")
    parts = parts.groupBy("lang", "size", "item").agg(F.sum("count").alias("count"))
    place = F.row_number().over(W.partitionBy("lang", "size").orderBy(F.col("count").desc(), "item"))
    counts = seen.select("lang", F.lit(0).alias("size"), "item", "count").unionByName(parts).withColumn("_at", place)
    kept = counts.filter(F.col("_at") <= F.when(F.col("size") == 0, words).otherwise(grams))
    tables: dict[int, dict[str, dict[str, int]]] = {size: {} for size in (0, *ORDERS)}
    found = kept.select("lang", "size", "item", "count").orderBy("size", "item", "lang").toArrow()
    for lang, size, item, count in zip(*(c.to_pylist() for c in found.columns), strict=True):
        tables[size].setdefault(item, {})[lang] = count
    langs = sorted({lang for of in tables.values() for by_lang in of.values() for lang in by_lang})
    places, at = {}, 0
    for size, of in tables.items():
        places[size] = dict(zip(of, range(at, at + len(of)), strict=True))
        at += len(of)
    logs = np.concatenate([_logs(of, langs) for of in tables.values()])
    return LanguageModel(langs, places.pop(0), places, logs)


def held_out(docs: DataFrame, parts: int = 4, left: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, a null id being an empty one."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % parts == left


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without languages; rows
    that repeat get equal results; very long texts are scored whole; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = sent.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs).alias("held_out"), docs["text"])
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")
