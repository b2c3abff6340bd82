"""Subject areas of documents: averaged word and subword embeddings with one independent logistic output per area.

A document is cut into sections at its headings. The embedding of a text is the weighted mean of those of its words and
of the pieces of its words; each area's output is a logistic function of that mean. Training is synchronous: in every
round all partitions of the labelled sample compute their gradients at the same weights, the driver adds them up and
takes one step, so the result does not depend on how the sample is partitioned (but for rounding). Then every section
of every document is scored; a document has an area if one of its sections is clearly about it, so a second area with
sections of its own counts and a passing mention does not.

Only the labelled sample is bounded (`most_labelled`). The vocabulary is every feature of at least MIN_DOCS of its
documents that is not too common, so it grows with the sample only. How common and how rare a feature is, is counted
over all documents, in a pass of its own with partial counts. All documents are scored whole, where they lie, without a shuffle.
"""

from __future__ import annotations

import html
import io
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from brindle.storage import free_name, materialize, spread

#: Bound of the sample; features of fewer labelled documents, or of a larger share, are left out.
MOST_LABELLED, MIN_DOCS, MAX_SHARE = 20_000, 2, 0.2
#: Length of the mean below which a short text counts as less sure; size of the embeddings; rounds; step; labelled documents
#: of a part. Rounds, step and SURE stand in the middle of what five splits of the 983 labels of one corpus find equally
#: good (F1 0.933 to 0.936 with 12 to 32 rounds and 0.5 to 0.8); more rounds only learn the labellers' mistakes.
FLOOR, WIDTH, ROUNDS, STEP, PART = 30.0, 16, 16, 0.1, 1500
#: A section with at least this output has the area.
SURE = 0.7
PIECE = 5
#: Words and characters of lines kept with their features, characters of the texts that are scored together.
CACHE, LINES, TOGETHER = 1 << 18, 1 << 23, 1 << 20

#: Characters that show nothing.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ASIDE = re.compile(r"<ref[^<>]*/>|<ref[^<>]*>.*?</ref>|<!--.*?-->", re.S | re.I)
_ADDRESS = re.compile(r"https?://\S+", re.I)
_HEADING = re.compile(r"[ \t]*==+[^=]+==+[ \t]*")
_WORD = re.compile(r"[^\W\d_]{2,}")
#: The same for ASCII lines in lower case.
_ASCII_WORD = re.compile("[a-z]{2,}")
_DAMAGED = re.compile("[ÂÃ][\u0080-¿Œ-Ÿˆ-™]")


def _mend(m: re.Match) -> str:
    return m[0].encode("cp1252", "ignore").decode("utf-8", "ignore")


def lines(text: str | None) -> list[str]:
    """Lines of a text without references, comments and escapes; any line separator ends a line."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    return (_ASIDE.sub(" ", t) if "<" in t else t).splitlines()


def words(line: str) -> list[str] | None:
    """Words of a line in lower case, without addresses and invisible characters; UTF-8 that was read as Windows-1252 is
    mended. None for a heading."""
    plain = line.isascii()
    if not plain:
        line = unicodedata.normalize("NFKC", _UNSEEN.sub("", _DAMAGED.sub(_mend, line)))
    if "://" in line:
        line = _ADDRESS.sub(" ", line)
    if "==" in line and _HEADING.fullmatch(line):
        return None
    return (_ASCII_WORD if plain else _WORD).findall(line.lower())


def sections(text: str | None) -> list[list[str]]:
    """Words of a text by section: before, between and behind its headings."""
    out: list[list[str]] = [[]]
    for x in lines(text):
        ws = words(x)
        if ws is None:
            out.append([])
        else:
            out[-1] += ws
    return out if text else []


def features(word: str) -> list[str]:
    """The word, and its pieces of PIECE characters with its ends marked."""
    if len(word) < PIECE:
        return [word]
    x = f"<{word}>"
    return [word, *("#" + x[i : i + PIECE] for i in range(len(x) - PIECE + 1))]


class Rows:
    """A sparse matrix by rows: of sections or of documents, by features."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, weight: np.ndarray):
        self.start, self.ids, self.weight, self.n = start, ids, weight, len(start) - 1

    def mean(self, table: np.ndarray) -> np.ndarray:
        """The product with a table of features by something: one product of a vector and the rows it needs for each row."""
        out = np.zeros((self.n, table.shape[1]), np.float32)
        start = self.start.tolist()
        for i, (lo, hi) in enumerate(zip(start, start[1:])):
            if hi > lo:
                out[i] = self.weight[lo:hi] @ table.take(self.ids[lo:hi], axis=0)
        return out

    def back(self, table: np.ndarray, n: int) -> np.ndarray:
        """The product of the transposed matrix, which has n rows, with a table of this one's rows by something."""
        times, out = np.diff(self.start), np.empty((n, table.shape[1]), np.float32)
        for k in range(table.shape[1]):
            out[:, k] = np.bincount(self.ids, weights=np.repeat(table[:, k], times) * self.weight, minlength=n)
        return out


class Vocabulary:
    """Features with numbers, and their weights by rarity. Lines that were met lately keep their features' numbers:
    revisions of a page share most lines."""

    def __init__(self, names: list[str], rarity: np.ndarray):
        self.number = {f: i for i, f in enumerate(names)}
        self.rarity = rarity.astype(np.float32)
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes | None] = {}
        self.kept = 0  # characters of `lines`

    def word(self, w: str) -> bytes:
        if len(self.words) >= CACHE:
            self.words.clear()
        x = np.array([i for f in features(w) if (i := self.number.get(f)) is not None], np.int32).tobytes()
        self.words[w] = x
        return x

    def line(self, line: str) -> bytes | None:
        """Numbers (int32 bytes) of a line's features, None for a heading."""
        known, ws = self.words, words(line)
        x = None if ws is None else b"".join([known[w] if w in known else self.word(w) for w in ws])
        if self.kept >= LINES:
            self.lines.clear()
            self.kept = 0
        self.lines[line] = x
        self.kept += len(line)
        return x

    def sections(self, text: str | None) -> list[bytes]:
        out, part, known = [], [], self.lines
        for x in lines(text):
            f = known[x] if x in known else self.line(x)
            if f is None:
                out.append(b"".join(part))
                part = []
            else:
                part.append(f)
        return [*out, b"".join(part)] if text else []

    def rows(self, texts: list[str | None], by_section: bool) -> tuple[Rows, np.ndarray]:
        """One row per section or text, and the text each belongs to. Weights: root of the count times rarity, summing to
        1 where there is enough text."""
        ids, owner = [], []
        for i, t in enumerate(texts):
            found = self.sections(t)
            for x in found if by_section else [b"".join(found)] if found else []:
                ids.append(x)
                owner.append(i)
        n = np.array([len(x) // 4 for x in ids], np.int64)
        size = max(len(self.rarity), 1)
        key = np.repeat(np.arange(len(ids)), n) * size + np.frombuffer(b"".join(ids), np.int32)
        key, times = np.unique(key, return_counts=True)
        row, f = np.divmod(key, size)
        told = self.rarity[f] > 0  # features that tell nothing have no rarity
        row, f, times = row[told], f[told], times[told]
        weight = np.sqrt(times).astype(np.float32) * self.rarity[f]
        total = np.bincount(row, weights=weight, minlength=len(ids))
        weight = (weight / np.maximum(total, FLOOR)[row]).astype(np.float32)
        return Rows(np.searchsorted(row, np.arange(len(ids) + 1)), f.astype(np.int32), weight), np.array(owner, np.int64)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(key: str, names: list[str], rarity: np.ndarray) -> Vocabulary:
    """The worker's vocabulary of a model, made once a process; what it knows of words and lines holds for all passes."""
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(names, rarity)
    v = _vocabularies[key]
    v.rarity = rarity.astype(np.float32)
    return v


class Growing(Vocabulary):
    """A vocabulary that takes every feature it meets, and counts the texts that hold it."""

    def __init__(self):
        super().__init__([], np.zeros(0))
        self.n = np.zeros(1 << 10, np.int64)

    def word(self, w: str) -> bytes:
        for f in features(w):
            self.number.setdefault(f, len(self.number))
        return super().word(w)

    def add(self, text: str | None) -> None:
        own = np.unique(np.frombuffer(b"".join(self.sections(text)), np.int32))
        while len(self.n) < len(self.number):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        self.n[own] += 1


def _seen(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Features of texts, and in how many they are; a full vocabulary is passed on."""
    v = Growing()
    for b in batches:
        for t in b.column(0).to_pylist():
            v.add(t)
            if len(v.number) > most:
                yield pa.RecordBatch.from_pydict({"f": pa.array(list(v.number), pa.string()), "n": pa.array(v.n[: len(v.number)])})
                v = Growing()
    yield pa.RecordBatch.from_pydict({"f": pa.array(list(v.number), pa.string()), "n": pa.array(v.n[: len(v.number)])})


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(part: dict[str, np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over a part's documents of the gradients of the logistic losses: of embeddings, outputs and their offsets."""
    x = Rows(part["start"], part["ids"], part["weight"])
    mean = x.mean(weights[0])
    error = (_sigmoid(mean @ weights[1] + weights[2]) - part["target"]).astype(np.float32)
    return [x.back(error @ weights[1].T, len(weights[0])), mean.T @ error, error.sum(axis=0)]


class Adam:
    """Steps by the mean and the spread of past gradients."""

    def __init__(self, weights: list[np.ndarray], step: float):
        self.weights, self.step, self.t = weights, step, 0
        self.m, self.v = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def take(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.step * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


class Model:
    def __init__(self, areas: list[str], names: list[str], rarity: np.ndarray, weights: list[np.ndarray], key: str | None = None):
        self.areas, self.names, self.rarity, self.weights, self.key = areas, names, rarity, weights, key or uuid.uuid4().hex

    def scorer(self):
        """texts -> texts x areas: the highest output over a text's sections, 0 without text."""
        words = vocabulary(self.key, self.names, self.rarity)

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.zeros((len(texts), len(self.areas)), np.float32)
            rows, owner = words.rows(texts, True)
            if rows.n:
                known = np.diff(rows.start) > 0
                np.maximum.at(out, owner[known], _sigmoid(rows.mean(self.weights[0]) @ self.weights[1] + self.weights[2])[known].astype(np.float32))
            return out

        return score


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < TOGETHER):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def distinct(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The different numbers among `ids`, without a sort: each where it stands last. `place` is room for one number each."""
    at = np.arange(len(ids), dtype=np.int32)
    place[ids] = at
    return ids[place[ids] == at]


def document_counts(texts: DataFrame, names: list[str], key: str) -> tuple[int, np.ndarray]:
    """The number of all texts, and of those that hold each feature. Each task sends one partial count per feature."""
    if not names:
        return 0, np.zeros(0)
    shared = texts.sparkSession.sparkContext.broadcast(names)  # features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = vocabulary(key, shared.value, np.zeros(len(shared.value))), np.zeros(len(shared.value) + 1, np.int64)
        place = np.zeros(len(shared.value), np.int32)
        for b in batches:
            for t in b.column(0).to_pylist():
                n[distinct(np.frombuffer(b"".join(words.sections(t)), np.int32), place)] += 1
                n[-1] += 1  # counts the texts
        f = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"f": pa.array(f.astype(np.int32)), "n": pa.array(n[f])})

    out = np.zeros(len(names) + 1)
    for r in spread(texts).mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, areas: list[str], doc: str, text: str, label: str, most_labelled: int = MOST_LABELLED, most_features: int | None = None, rounds: int = ROUNDS, width: int = WIDTH, step: float = STEP, part: int = PART, max_share: float = MAX_SHARE, seed: int = 1) -> Model:
    """A model trained on the labelled documents. `labels` has rows (doc, label), several per document if it has several
    areas; a null label says that there is none, and labels that are not in `areas` are left out. The sample is
    the `most_labelled` documents whose ids have the smallest hashes. Features of more than `max_share` of all documents
    tell no area from another; raise it where there are only a few areas. All other features of MIN_DOCS documents are kept
    unless `most_features` asks for only the most frequent. Without any usable label the model finds nothing."""
    spark = docs.sparkSession
    by_doc = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("d")).agg(F.collect_set(F.when(F.col(label).isin(areas), F.col(label))).alias("areas"))
    sample = by_doc.orderBy(F.xxhash64("d"), "d").limit(most_labelled)
    texts = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).where("t is not null and trim(t) <> ''")
    # The sample's ids are at most `most_labelled` rows, so the texts stay where they are.
    parts = max(1, -(-min(most_labelled, by_doc.count()) // part))
    labelled = materialize(texts.join(F.broadcast(sample), "d").select("t", "areas").repartition(parts), "labelled")

    counts = labelled.select("t").mapInArrow(_seen, "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    learnt = sorted(r["f"] for r in counts.where((F.col("f") != "") & (F.col("n") >= MIN_DOCS)).select("f").collect())  # features of the bounded sample
    key = uuid.uuid4().hex
    n, everywhere = document_counts(texts.select("t"), learnt, key)
    top = [i for i in np.argsort(-everywhere, kind="stable") if 0 < everywhere[i] <= max_share * n][:most_features]
    names, rarity = learnt, np.zeros(len(learnt))  # features that are too common keep their number and have no rarity
    rarity[top] = np.log(n / everywhere[top])
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.1, (len(names), width)), rng.normal(0, 0.3, (width, len(areas))), np.full(len(areas), -2.0)]
    weights = [w.astype(np.float32) for w in weights]
    if not top:
        return Model(areas, names, rarity, weights, key)
    words = spark.sparkContext.broadcast((names, rarity))  # features of the bounded sample

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary(key, *words.value)
        for b in batches:
            texts, labels = (c.to_pylist() for c in b.columns)
            for lo, hi in _chunks(texts):  # one matrix per so many characters, so that no task holds all of its part
                x, owner = numbers.rows(texts[lo:hi], False)
                if not x.n:
                    continue
                target = np.array([[a in r for a in areas] for r in labels[lo:hi]], np.float32)[owner]
                blob = _save(start=x.start, ids=x.ids, weight=x.weight, target=target)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(owner)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    sparse = materialize(labelled.mapInArrow(matrices, "n bigint, blob binary"), "matrices").persist(StorageLevel.MEMORY_AND_DISK)
    total = sparse.agg(F.sum("n")).first()[0] or 1
    adam = Adam(weights, step)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            summed = None
            for b in batches:
                for blob in b.column(0).to_pylist():
                    g = gradient(dict(np.load(io.BytesIO(blob))), now.value)
                    summed = [s + x for s, x in zip(summed, g)] if summed else g
            if summed:
                own = np.nonzero(summed[0].any(axis=1))[0]
                summed[0] = summed[0][own]  # embeddings of features that the part lacks have no gradient
                yield pa.RecordBatch.from_pydict({"own": pa.array([own.astype(np.int32).tobytes()], pa.binary()), "g": pa.array([np.concatenate([x.ravel() for x in summed]).astype(np.float32).tobytes()], pa.binary())})

        # At most `parts` gradients, each of the features in its part of the bounded sample.
        summed = [np.zeros_like(w) for w in weights]
        for r in sparse.select("blob").mapInArrow(work, "own binary, g binary").collect():
            own = np.frombuffer(bytes(r["own"]), np.int32)
            cut = np.cumsum([own.size * width, weights[1].size])
            inner, outer, offset = np.split(np.frombuffer(bytes(r["g"]), np.float32), cut)
            summed[0][own] += inner.reshape(-1, width)
            summed[1] += outer.reshape(weights[1].shape)
            summed[2] += offset
        adam.take([g / total for g in summed])
        now.destroy()
    sparse.unpersist()
    return Model(areas, names, rarity, weights, key)


def classify(docs: DataFrame, model: Model, text: str, keep: list[str], sure: float = SURE, subject: str = "subject") -> DataFrame:
    """The kept columns of every row with each of its areas: one row per document and area, none for a document without.

    Null, empty and blank texts have no area. Texts of any length are read whole; repeated rows are scored each. The new
    columns `subject` and `score` get an underscore where a kept column has their name. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names)), F.col(text).cast("string").alias("t"))
    types = ", ".join([*(f"{k} {source.schema[k].dataType.simpleString()}" for k in names), "subject string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        score = model.scorer()
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            for lo, hi in _chunks(texts):
                out = score(texts[lo:hi])
                row, area = np.nonzero(out >= sure)
                at = pa.array(row)
                cols = [c.slice(lo, hi - lo).take(at) for c in b.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([model.areas[a] for a in area], pa.string()), pa.array(out[row, area].astype(np.float64))], names=[*names, "subject", "score"])

    done = spread(source).mapInArrow(run, types)
    new = free_name(subject, keep)
    return done.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), F.col("subject").alias(new), F.col("score").alias(free_name("score", [*keep, new])))
