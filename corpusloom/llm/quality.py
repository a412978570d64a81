"""Quality classifier by co-training.

View A sees the text's content: hashed words, hashed word endings, the shares
of distinct words and word pairs, and of character classes.  View B sees the
page's metadata: source, language, length and line layout.  Both are logistic
regressions, calibrated on labelled documents that neither trained on (Platt
scaling on a fifth of each class).  In each round either view scores every
document outside the labelled sample, labels the ``GROW`` that it is surest of,
in the proportion of the labelled classes and if its calibrated confidence is
``SURE`` or more, and gives them to the other view's training set.  Every
document's score combines the views: the sum of their calibrated log-odds, less
the classes' own, which both contain.

Fitting uses at most ``SAMPLE`` labelled documents, those with the least hash
of doc_id, and what the rounds exchange.  A round is one pass over all other
documents; a task keeps only its own surest ones.  Scoring covers all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, distinct, materialize
from corpusloom.llm.words import CHUNK, M, mix, word_hashes

SAMPLE, ROUNDS, GROW, SURE = 4000, 2, 200, 0.9
WORDS, ENDS, META = 1024, 256, 64
SEED, STEPS, RIDGE = 5, 100, 1e-3
CONTENT = WORDS + ENDS + 10
SHAPE = META + 5
#: Shares of upper-case, lower-case, digit, space and other bytes are drawn towards these by so many bytes.
USUAL, DRAW = np.array([0.02, 0.8, 0.0, 0.16, 0.02]), 60
#: Texts are looked at in parts of so many bytes, cut at white space; distinct words count by part.
PART = 1 << 20
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _c = bytes([_i])
    _CLASS[_i] = 0 if _c.isupper() else 1 if _c.islower() or _i >= 128 else 2 if _c.isdigit() else 3 if _c.isspace() else 4
def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts cut into parts, in groups of about ``CHUNK`` bytes: the number of each part's text, and the parts."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        start = 0
        while start < len(t):
            end = len(t)
            if end - start > PART:
                space = max(t.rfind(c, start, start + PART) for c in (b" ", b"\n"))
                end = space if space > start else start + PART
            if held and size + end - start > CHUNK:
                yield np.array(at), held
                at, held, size = [], [], 0
            at.append(i)
            held.append(t[start:end])
            size += end - start
            start = end
    if held:
        yield np.array(at), held


def _class_counts(text: bytes) -> np.ndarray:
    counts = sum(np.bincount(np.frombuffer(text, np.uint8, min(CHUNK, len(text) - i), i), minlength=256) for i in range(0, len(text), CHUNK))
    return np.bincount(_CLASS, np.broadcast_to(counts, 256), minlength=5)


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values of ``h`` each of ``n`` parts has."""
    found = distinct((own.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
    return np.bincount((found >> np.uint64(43)).astype(np.int64), minlength=n)


def content(texts: list[bytes]) -> np.ndarray:
    """View A of whole texts, a row each."""
    n = len(texts)
    words, ends, rest = np.zeros((n, WORDS)), np.zeros((n, ENDS)), np.zeros((n, 4))
    shares = np.array([_class_counts(t) for t in texts], np.float64).reshape(n, 5)
    for at, parts in _parts(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        a, z, own, h = word_hashes(data, _CLASS[data] != 3, edge)
        if not len(a):
            continue
        tail = data[z].astype(np.int64) * 7 + np.where(z > a, data[z - 1].astype(np.int64) * 61, 0)
        doc = at[own]
        np.add(words, np.bincount(doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS), out=words)
        np.add(ends, np.bincount(doc * ENDS + tail % ENDS, minlength=n * ENDS).reshape(n, ENDS), out=ends)
        same = own[1:] == own[:-1]
        pair = mix(h[:-1] * np.uint64(M) + h[1:])[same]
        for k, x in enumerate((np.bincount(own, minlength=len(parts)), _distinct(own, h, len(parts)), np.bincount(own[1:][same], minlength=len(parts)), _distinct(own[1:][same], pair, len(parts)))):
            np.add.at(rest[:, k], at, x)
    x = np.zeros((n, CONTENT), np.float32)
    for i, counts in ((0, words), (WORDS, ends)):
        v = np.log1p(counts)
        x[:, i : i + v.shape[1]] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    size = shares.sum(axis=1, keepdims=True)
    mixed = np.where(size > 0, (shares + DRAW * USUAL) / (size + DRAW), 0)
    some = rest[:, 0] > 0
    x[:, -10] = np.where(some, rest[:, 1] / np.maximum(rest[:, 0], 1), 0)
    x[:, -9] = np.where(some, (rest[:, 3] + 1) / (rest[:, 2] + 1), 0)
    x[:, -8] = np.where(some, 1 / np.sqrt(np.maximum(rest[:, 0], 1)), 0)
    x[:, -7:-2] = mixed * 3
    x[:, -2], x[:, -1] = mixed[:, 4] > 0.08, mixed[:, 0] > 0.3
    return x


def metadata(texts: list[bytes], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """View B of pages, a row each: of the text only its length and how it lies in lines."""
    x = np.zeros((len(texts), SHAPE), np.float32)
    for i, (t, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        x[i, zlib.crc32(f"source={source}".encode()) % META] = 1
        x[i, zlib.crc32(f"lang={lang}".encode()) % META] = 1
        n = len(t)
        if n:
            lines = t.count(b"\n") + 1
            x[i, META:] = math.log1p(n) / 10, math.log1p(lines) / 5, math.log1p(n / lines) / 7, t.count(b"\n\n") / lines, 1 / math.sqrt(n)
    return x


@dataclass
class View:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> View:
    """Ridge logistic regression with balanced classes, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    rate = 4 / float((np.square(x).sum(axis=1) * share).sum() + 4 * RIDGE)
    w, ahead, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
    for _ in range(STEPS):
        new = ahead - rate * (x.T @ (share * (sigmoid(x @ ahead) - y)) + RIDGE * ahead).astype(np.float32)
        up = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / up * (new - w), new, up
    return View(w.astype(np.float64))


def platt(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the view's calibrated log-odds, by Newton steps on smoothed targets."""
    z, pos, neg = view.raw(x), (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    a = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = sigmoid(a @ theta)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    view.slope, view.shift = max(float(theta[0]), 1e-3), float(theta[1])


@dataclass
class Model:
    a: View | None
    b: View | None
    prior: float

    def scores(self, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
        if self.a is None:
            return np.full((len(xa), 3), self.prior)
        za, zb = self.a.logit(xa), self.b.logit(xb)
        return np.stack([sigmoid(za), sigmoid(zb), sigmoid(za + zb - math.log(self.prior / (1 - self.prior)))], axis=1)


def fit_views(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, given_a: tuple | None = None, given_b: tuple | None = None) -> Model:
    """Both views from the labelled rows and what each was given (features, labels); the last fifth of each class only calibrates.

    If a fifth of a class is less than a row, all rows train and the views stay uncalibrated.
    """
    prior = float(y.mean()) if len(y) else 1.0
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    if not all(map(len, classes)):
        return Model(None, None, prior)
    calibrated = all(len(c) >= 5 for c in classes)
    held = np.zeros(len(y), bool)
    if calibrated:
        held[np.concatenate([c[len(c) - len(c) // 5 :] for c in classes])] = True
    views = []
    for x, given in ((xa, given_a), (xb, given_b)):
        more, label = given or (x[:0], y[:0])
        view = fit(np.vstack([x[~held], more]), np.concatenate([y[~held], label]))
        if calibrated:
            platt(view, x[held], y[held])
        views.append(view)
    return Model(*views, prior)


def surest(z: np.ndarray, keys: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Places of the surest positive and negative rows by (log-odds, key), each key once; less sure ones than ``SURE`` are left out."""
    _, first = np.unique(keys, return_index=True)
    out, least = [], math.log(SURE / (1 - SURE))
    for side, most in ((z >= least, positives), (z <= -least, negatives)):
        at = first[side[first]]
        out.append(at[np.lexsort((keys[at], -np.abs(z[at])))][:most])
    return np.concatenate(out)


FEATURES = "key bigint, label int, a array<float>, b array<float>"


def _views_of(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return content(whole), metadata(whole, langs.to_pylist(), sources.to_pylist())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, m = _views_of(*(b.column(i) for i in (2, 3, 4)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(a), pa.list_(pa.float32())), pa.array(list(m), pa.list_(pa.float32()))], names=["key", "label", "a", "b"])


WEIGHTS = "a array<double>, b array<double>, scale array<double>, prior double"


def _fit(found: pa.Table) -> pa.Table:
    """The model from the features of labelled rows (view 2) and of rows given to view 0 or 1, as one row."""
    found = found.take(np.lexsort((found["key"].to_numpy(), found["view"].to_numpy())))
    label, view = found["label"].to_numpy(), found["view"].to_numpy()
    a, b = (found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("a", CONTENT), ("b", SHAPE)))
    m = fit_views(a[view == 2], b[view == 2], label[view == 2], (a[view == 0], label[view == 0]), (b[view == 1], label[view == 1]))
    views = [v for v in (m.a, m.b) if v is not None]
    row = {"a": views[0].weights.tolist() if views else [], "b": views[1].weights.tolist() if views else [], "scale": [x for v in views for x in (v.slope, v.shift)], "prior": m.prior}
    return pa.Table.from_pylist([row], pa.schema([(c, pa.list_(pa.float64())) for c in ("a", "b", "scale")] + [("prior", pa.float64())]))


def _model(rows: DataFrame) -> Model:
    """Fit in one task: the rows are the labelled sample and what the rounds exchanged, both bounded by parameters."""
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_fit, WEIGHTS).first()
    if found is None or not found["scale"]:
        return Model(None, None, found["prior"] if found else 1.0)
    views = [View(np.array(found[c]), *found["scale"][i : i + 2]) for c, i in (("a", 0), ("b", 2))]
    return Model(views[0], views[1], found["prior"])


def _keyed(docs: DataFrame) -> DataFrame:
    """key (a hash of what the views see), doc_id, text, lang, source."""
    return docs.select(F.xxhash64("text", "lang", "source").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def pick(docs: DataFrame, model: Model, known: set[int], taken: set[int], grow: int) -> list[tuple[int, int, int]]:
    """(view that is given it, key, label) of the documents that either view is surest of.

    Documents in ``known`` (doc_ids) and ``taken`` (keys) are left out; all others
    are scored, and each task keeps its surest ones, so that the exact surest
    of all meet in the end.
    """
    spark = docs.sparkSession
    positive = round(grow * model.prior)
    held = spark.sparkContext.broadcast((model, np.array(sorted(known), np.int64), np.array(sorted(taken), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, taken = held.value
        best = [(np.zeros(0), np.zeros(0, np.int64)), (np.zeros(0), np.zeros(0, np.int64))]
        for b in batches:
            ids, keys = b.column(1).fill_null(-1).to_numpy(), b.column(0).to_numpy()
            free = ~(np.isin(ids, known) & b.column(1).is_valid().to_numpy(zero_copy_only=False)) & ~np.isin(keys, taken)
            b, keys = b.filter(pa.array(free)), keys[free]
            if not b.num_rows:
                continue
            for i, (view, x) in enumerate(zip((model.a, model.b), _views_of(*(b.column(i) for i in (2, 3, 4))), strict=True)):
                z, k = np.concatenate([best[i][0], np.round(view.logit(x), 9)]), np.concatenate([best[i][1], keys])
                at = surest(z, k, positive, grow - positive)
                best[i] = z[at], k[at]
        for i, (z, k) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), 1 - i, np.int32)), pa.array(k), pa.array(z)], names=["view", "key", "z"])

    best = materialize(_keyed(docs).mapInArrow(run, "view int, key bigint, z double"), "quality-surest")
    best = best.groupBy("view", "key").agg(F.max("z").alias("z"))
    sides = [best.where((F.col("view") == v) & (F.col("z") * s > 0)).orderBy(F.desc(F.abs("z")), "key").limit(n) for v in (0, 1) for s, n in ((1, positive), (-1, grow - positive)) if n]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return sorted((r["view"], r["key"], int(r["z"] > 0)) for r in out.collect())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, grow: int = GROW) -> Model:
    """Co-train: at most ``sample`` labelled documents, all others for the rounds' exchange.

    The driver sees the sample's ids, at most ``2 * grow`` keys a round, and the weights.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    order = (F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("doc_id"))
    labelled = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("label"))
    chosen = materialize(labelled.orderBy(*order).limit(sample), "quality-sample")
    rows = _keyed(docs).join(F.broadcast(chosen), "doc_id")  # sample rows at most, but for repeated doc_ids
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("text", "lang", "source")).alias("d"))
    rows = rows.select(F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("key"), "label", "d.text", "d.lang", "d.source").mapInArrow(_features, FEATURES)
    rows = materialize(rows.withColumn("view", F.lit(2)), "quality-labelled")
    model = _model(rows)
    if model.a is None:
        return model
    known, taken = {r["doc_id"] for r in chosen.select("doc_id").collect()}, set()
    for _ in range(rounds):
        found = pick(docs, model, known, taken, grow)
        if not found:
            break
        taken |= {k for _, k, _ in found}
        wanted = spark.createDataFrame(found, "view int, w_key bigint, label int")
        keyed = _keyed(docs)
        once = keyed.join(F.broadcast(wanted.select("w_key").distinct()), keyed.key == F.col("w_key")).groupBy("key").agg(F.first(F.struct("text", "lang", "source")).alias("d"))
        given = once.select("key", F.lit(0).alias("label"), "d.text", "d.lang", "d.source").mapInArrow(_features, FEATURES).drop("label")
        given = given.join(F.broadcast(wanted), given.key == F.col("w_key")).select("key", "label", "a", "b", "view")
        rows = rows.unionByName(materialize(given, "quality-given"))
        model = _model(rows)
    return model


#: Documents that score below this go.
THRESHOLD = 0.5


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key (a hash of the text), p_content, p_metadata, score of each row of ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.scores(*_views_of(*(b.column(i) for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[:, i]) for i in range(3))], names=["doc_id", "text_key", "p_content", "p_metadata", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text", "lang", "source")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, p_content double, p_metadata double, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every row of ``docs``: ``classify`` with keep = score >= ``THRESHOLD``.

    Null text counts as empty, null source and language are values of their
    own, repeated rows each get their score, labels of unknown or null doc_ids
    are ignored and conflicting ones averaged.  With fewer than two classes of
    labels every row's score is their mean, 1 without labels.
    """
    return classify(docs, train(docs, labels)).withColumn("keep", F.col("score") >= THRESHOLD)


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, columns unchanged; one pass over the texts, no exchange."""
    spark, model = docs.sparkSession, train(docs, labels)
    held = spark.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.scores(*_views_of(*(b.column(i) for i in at)))[:, 2] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
