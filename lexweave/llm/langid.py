"""Language identification in two levels: a linear SVM per language family, then one-versus-one linear SVMs
between the languages of the family that wins.

Features are hashed one- to three-letter runs of the lower-cased text (a gap between words counts as one letter),
square-rooted and scaled to length one. The classifiers are fitted on the driver on at most SAMPLE labelled
documents of each label, whatever the number of labels; a document contributes BUCKETS numbers whatever its length.

The scores tell languages from each other, not language from junk, so the pipeline also asks how near a text is to the
mean vector of its nearest label. Near texts of one length reach a floor that learn_floors() sets on every labelled document that may
be learned from, cut to that length and held against the means of all others, and on junk made of the same letters in random order.

Defined cases: a null text or one without letters is ``und`` with score 0; so is every text if nothing is
labelled; with one label only, that label is predicted; a very long text is read whole; a null doc_id is never learned from
and not held out; of the rows that share a doc_id one is learned from, the smallest by label and features, and all are
predicted; equal votes of the duels go to the larger margins, then to the label first in the alphabet; an empty table gives
no row; further columns of any name don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, materialise, slices

SAMPLE = 400
#: Rows that the driver learns from in all (4096 numbers in single precision each): many labels share them evenly.
SAMPLE_ROWS = 24_000
BUCKETS = 4096
UNKNOWN = "und"
#: Labels whose sums a task holds at once.
HELD_LABELS = 256
#: Steps of one: of a feature in sums, which are whole numbers so that they don't hang on their order, and of a nearness, whose
#: quantiles are taken over counted steps.
FEATURE_STEPS, NEAR_STEPS = 1 << 32, 10_000
#: Characters of the beginnings that floors are set at, the fewest of them, how many spreads below their median is
#: still a text (the spread is that of the middle half, so labelled junk doesn't lower it), and the share of junk to reject.
LENGTHS = (25, 50, 100, 200, 400, 800, 1600, 3200)
FEWEST = 20
SPREADS = 4.0
JUNK = 0.995
#: Below this score (no evidence at either level) a document's language counts as not identified.
MIN_SCORE = 0.25
#: The family of a language code; any other label is a family of its own.
FAMILY = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tt", "tk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
}
_OF = {code: family for family, codes in FAMILY.items() for code in codes}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counted(text: str | None) -> np.ndarray | None:
    """How often each feature occurs, or None for a text without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    codes = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]]).astype(np.uint32)
    keep = codes != 0
    if not keep.any():
        return None
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    codes = codes[keep]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    one = codes[codes != 0] * np.uint32(0x9E3779B1)
    two = codes[:-1] * np.uint32(0x85EBCA6B) + codes[1:] * np.uint32(0xC2B2AE35)
    three = two[:-1] * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1)
    hashed = np.concatenate([one, two, three])
    hashed ^= hashed >> np.uint32(15)
    return np.bincount((hashed * np.uint32(0x2C1B3C6D)) >> shift, minlength=BUCKETS)


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.float32(np.sqrt(counts.sum()))


def features(text: str | None) -> np.ndarray | None:
    """The scaled feature vector, or None for a text without letters."""
    counts = counted(text)
    return None if counts is None else _scaled(counts)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """L2-loss linear SVM by dual coordinate descent; y is +1 or -1. The classes weigh the same in all."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    slack, norms = 0.5 / (c * weight), np.array([float(r @ r) for r in x.astype(np.float32, copy=False)]) + 1
    alpha, w, bias, order = np.zeros(len(x)), np.zeros(x.shape[1]), 0.0, np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            row = x[i].astype(np.float64)  # a row at a time, so that no second matrix is held
            g = y[i] * (w @ row + bias) - 1 + alpha[i] * slack[i]
            new = max(0.0, alpha[i] - g / (norms[i] + slack[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * row
                bias += step
                alpha[i] = new
    return w, float(bias)


@dataclass
class Model:
    families: list[list[str]]
    family: tuple[np.ndarray, np.ndarray]
    pairs: list[list[tuple[int, int]]]
    within: list[tuple[np.ndarray, np.ndarray]]
    means: np.ndarray | None = None  # a column of length one per label
    floors: tuple[list[float], list[float]] = ((), ())  # logarithms of numbers of features, ascending, and the nearness wanted there

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        codes, of = np.array(labels), {}
        for label in sorted(set(labels)):
            of.setdefault(_OF.get(label.lower().split("-")[0].split("_")[0], label), []).append(label)
        families = [of[k] for k in sorted(of)]

        def stack(fits: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
            return np.array([w for w, _ in fits], np.float32).reshape(len(fits), x.shape[1]).T.copy(), np.array([b for _, b in fits], np.float32)

        first = stack([linear_svm(x, np.where(np.isin(codes, f), 1, -1)) for f in families] if len(families) > 1 else [])
        pairs = [list(combinations(range(len(f)), 2)) for f in families]
        within = []
        for f, ps in zip(families, pairs, strict=True):
            fits = []
            for a, b in ps:
                rows = (codes == f[a]) | (codes == f[b])
                fits.append(linear_svm(x[rows], np.where(codes[rows] == f[a], 1, -1)))
            within.append(stack(fits))
        return cls(families, first, pairs, within)

    def nearness(self, text: str | None) -> tuple[float, float] | None:
        """The logarithm of a text's number of features, and its nearness to the nearest label's mean."""
        counts = counted(text)
        return None if counts is None else (float(np.log(counts.sum())), float((_scaled(counts) @ self.means).max()))

    def identified(self, text: str | None, min_score: float) -> bool:
        """Whether a language is found with the score wanted and the text is as near to one as texts of its length are."""
        label, score = self.predict(text)
        if label == UNKNOWN or score < min_score:
            return False
        if not self.floors[0]:
            return True
        n, near = self.nearness(text)
        return near >= float(np.interp(n, *self.floors))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        score, best = 1.0, 0
        if len(self.families) > 1:
            margins = x @ self.family[0] + self.family[1]
            best = int(np.argmax(margins))
            score = _sure(float(margins[best] - np.delete(margins, best).max()) / 2)
        names, pairs = self.families[best], self.pairs[best]
        if not pairs:
            return names[0], score
        margins = x @ self.within[best][0] + self.within[best][1]
        votes = np.zeros(len(names))
        for (a, b), m in zip(pairs, margins.tolist(), strict=True):
            votes[a if m > 0 else b] += 1
            votes[a] += 1e-3 * np.tanh(m)
            votes[b] -= 1e-3 * np.tanh(m)
        won = int(np.argmax(votes))
        own = [m if a == won else -m for (a, b), m in zip(pairs, margins.tolist(), strict=True) if won in (a, b)]
        return names[won], score * _sure(min(own))


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * margin, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, floors: bool = False) -> Model:
    """Learn from labelled documents outside the held-out third: the classifiers from the ``sample`` smallest by a hash of doc_id per
    label, fewer if the labels would have more than SAMPLE_ROWS in all, the floors from all."""
    learn = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    ids = learn.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    counts = ids.groupBy("lang").count().collect()
    if not counts:
        return Model([], (np.zeros((BUCKETS, 0)), np.zeros(0)), [], [])
    sample = max(1, min(sample, SAMPLE_ROWS // len(counts)))
    # about twice as many as wanted, so that the rank below sees few rows; a label without a bound is taken whole
    bounds = [(row["lang"], int((1 << 40) * (2.0 * sample / row["count"]))) for row in counts if row["count"] > 4 * sample]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound bigint"))
    wanted = F.col("h") < F.coalesce("bound", F.lit(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    single = ids.join(bounds, "lang", "left").where(wanted).groupBy("doc_id", "h").agg(F.min("lang").alias("lang"))
    chosen = single.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            got = [features(t) for t in batch.column(1).to_pylist()]
            rows = [(i, label, x.tobytes()) for i, label, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), got, strict=True) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "x"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "text", "lang")
    read = texts.mapInArrow(run, "doc_id bigint, lang string, x binary")
    read = read.groupBy("doc_id").agg(F.min(F.struct("lang", "x")).alias("row")).select("doc_id", "row.*")
    rows = sorted(read.collect(), key=lambda r: r.doc_id)
    if not rows:
        return Model([], (np.zeros((BUCKETS, 0)), np.zeros(0)), [], [])
    x, labels = np.array([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows]
    model = Model.fit(x, labels)
    if floors:
        learn_floors(model, _single(learn.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").where(F.col("text").rlike(r"\p{L}"))))
    return model


def _single(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, lang, text) that share a doc_id the smallest by label and text. Only ids are shuffled, and the texts of such rows."""
    repeated = materialise(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.*")
    return rows.join(repeated, "doc_id", "left_anti").unionByName(one)


def _steps(text: str | None) -> np.ndarray | None:
    x = features(text)
    return None if x is None else np.rint(x.astype(np.float64) * FEATURE_STEPS).astype(np.int64)


def _sums(rows: DataFrame) -> dict[str, np.ndarray]:
    """The summed features of all rows of each label, in steps. Tasks add up first; a number per label and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for label, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([label] * at.size, pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "at", "steps"])
            sums.clear()

        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := _steps(text)) is not None:
                    if label not in sums and len(sums) == HELD_LABELS:
                        yield from told()
                    sums[label] = sums[label] + x if label in sums else x
        yield from told()

    added = rows.select("lang", "text").mapInArrow(run, "lang string, at int, steps bigint").groupBy("lang", "at").agg(F.sum("steps").alias("steps"))
    out = {}
    for row in added.groupBy("lang").agg(F.collect_list(F.struct("at", "steps")).alias("own")).select("lang", "own.at", "own.steps").toLocalIterator():
        out[row.lang] = np.zeros(BUCKETS, np.int64)
        out[row.lang][row["at"]] = row.steps
    return out


def _unit(steps: np.ndarray) -> np.ndarray:
    x = steps.astype(np.float64)
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


def learn_floors(model: Model, rows: DataFrame) -> None:
    """Means and floors of a model, from every row (lang, text): means of all, floors from the beginnings of each row, and their shuffled
    letters, held against means that the row itself is taken out of. Tasks count steps; at most NEAR_STEPS counts a length are shuffled."""
    sums = _sums(rows)
    if not sums:
        return
    labels = sorted(sums)
    model.means = np.array([_unit(sums[label]) for label in labels]).T.copy()
    shared = rows.sparkSession.sparkContext.broadcast(([sums[label] for label in labels], model.means, {label: k for k, label in enumerate(labels)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (added, means, places), counts = shared.value, Counter()
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) < LENGTHS[0] or (x := _steps(text)) is None:
                    continue
                own = places[label]
                others = _unit(added[own] - x)
                codes = np.frombuffer(text[: LENGTHS[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
                rnd = np.random.default_rng(zlib.crc32(codes.tobytes()))
                for length in LENGTHS:
                    if codes.size < length:
                        break
                    for kind, part in (("real", codes[:length]), ("junk", rnd.permutation(codes[:length]))):
                        if (n := counted(part.tobytes().decode("utf-32-le", "surrogatepass"))) is None:
                            continue
                        part_x = _scaled(n)
                        near = part_x @ means
                        near[own] = part_x @ others
                        counts[length, kind, round(float(near.max()) * NEAR_STEPS)] += 1
                        if kind == "real":
                            counts[length, "features", int(n.sum())] += 1
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["length", "kind", "steps", "n"])

    counted_steps = rows.select("lang", "text").mapInArrow(run, "length int, kind string, steps bigint, n bigint").groupBy("length", "kind", "steps").agg(F.sum("n").alias("n"))
    quantiles = F.percentile("steps", F.array(*map(F.lit, (0.25, 0.5, 0.75, JUNK))), F.col("n"))
    got = {(r.length, r.kind): r for r in counted_steps.groupBy("length", "kind").agg(quantiles.alias("q"), F.sum("n").alias("n")).collect()}  # three rows a length
    at, wanted = [], []
    for length in LENGTHS:
        if (length, "real") not in got or (length, "junk") not in got or got[length, "real"].n < FEWEST:
            continue
        low, middle, high, _ = got[length, "real"].q
        at.append(float(np.log(got[length, "features"].q[1])))
        wanted.append(min(middle - SPREADS * (high - low) / 1.349, got[length, "junk"].q[3]) / NEAR_STEPS)
    model.floors = at, wanted


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            got = [own.predict(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, sample))


def keep_identified(docs: DataFrame, sample: int = SAMPLE, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is found with min_score or more and which reach the floor of their length, with all their
    columns. Where
    nothing is labelled no language can be told: then only texts without letters go."""
    model = fit(docs, sample, floors=True)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list) -> tuple[list, None]:
        own = shared.value
        if not own.families:
            return [any(map(str.isalpha, t or "")) for t in texts], None
        return [own.identified(t, min_score) for t in texts], None

    return keep_rows(docs, decide)
