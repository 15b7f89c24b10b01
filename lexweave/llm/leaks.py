"""Secret scan: known shapes of secrets, and strings that look random by a battery of tests.

Known shapes (base spans): assign, access and hex, as PATTERNS and HEX say. Beside them, every run of MIN_LENGTH or more encoded signs that
overlaps no base span is a candidate. Its encoding is inferred: the smallest alphabet that holds its signs. Three tests each say how
the string fits a random one (fit), and two of them how it fits ordinary text (p):
  alphabet  chi-squared of its signs against a uniform alphabet, by its moments at this length; against text: pairs of equal signs,
            which text has more of than random strings, by the moments of the corpus's own letters
  runs      changes between lower case, upper case, digits and signs (of one class only: between the halves of the alphabet); against
            text: a bound on seeing so many at the corpus's rate
  serial    correlation of neighbours' places in the alphabet
A candidate that a test rejects as random (3 * min(fit) < MIN_FIT) has p = 1, and so have digits alone, since ordinary numbers are as
uniform as random ones; else p = 2 * min. Benjamini and Hochberg's step-up at
FALSE_RATE, over all candidates of a length class, says which are reported as ``random``; short strings, which the tests tell apart
less surely, thus have a limit of their own. Letters, rates and candidates are counted over the whole corpus; texts are read once.

Defined cases: a null or empty text has no span; places are code points; spans of different kinds may overlap, those of one kind
don't; repeated rows and null doc_ids are judged each; a very long text is read whole; without ordinary letters all are taken to be
equally frequent; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import Texts, code_points, runs
from .common import materialise, slices

#: The shapes, and the words that an assignment or an access key needs.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
NEEDED = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_LENGTH, VALUE_LENGTH = 24, 6
KINDS = ("assign", "access", "hex", "random")
#: Shortest candidate, length classes from these lengths on, levels.
MIN_LENGTH, CLASSES, MIN_FIT, FALSE_RATE = 16, (16, 24, 32, 48, 64), 0.03, 0.01
#: Alphabets of encodings, the smallest first; a mixture of all signs last.
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "decimal": _DIGIT, "hex": _DIGIT + "abcdef", "HEX": _DIGIT + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "base36": _DIGIT + _LOWER, "BASE36": _DIGIT + _UPPER,
    "letters": _UPPER + _LOWER, "base62": _UPPER + _LOWER + _DIGIT, "base64": _UPPER + _LOWER + _DIGIT + "+/", "base64url": _UPPER + _LOWER + _DIGIT + "-_", "mixed": _UPPER + _LOWER + _DIGIT + "+/-_",
}
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _table(groups: dict[int, str], size: type = np.uint8, rest: int = 0) -> np.ndarray:
    out = np.full(256, rest, size)
    for value, letters in groups.items():
        out[list(letters.encode())] = value
    return out


#: By byte: its class (0: none of an encoding), whether it may stand in a candidate, or in a hex span.
SIGN_CLASS = _table({1: _LOWER, 2: _UPPER, 3: _DIGIT, 4: "+/-_"})
_ENCODED, _HEX = SIGN_CLASS > 0, _table({1: ALPHABETS["hex"]}) > 0
_SETS = {name: frozenset(letters.encode()) for name, letters in ALPHABETS.items()}
_PLACES = {name: _table({i: c for i, c in enumerate(letters)}, np.int64) for name, letters in ALPHABETS.items()}


def _normal(z: float) -> float:
    """P(a standard normal value is z or less)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding(token: bytes) -> tuple[str, bytes]:
    """The name of the smallest alphabet that holds the signs, and the signs that are tested: a UUID's without dashes."""
    token = token.replace(b"-", b"") if _UUID.fullmatch(token) else token
    signs = set(token)
    return next(name for name, letters in _SETS.items() if signs <= letters), token


def changes_rate(name: str) -> float:
    """How often neighbours of a random string over the alphabet differ in class, or half if there is one class."""
    letters = ALPHABETS[name].encode()
    shares = np.bincount(SIGN_CLASS[list(letters)]) / len(letters)
    return 0.5 if shares.max() == 1 else 1 - float(shares @ shares)


_RATES = {name: changes_rate(name) for name in ALPHABETS}


def battery(token: bytes) -> tuple[str, int, int, int, float]:
    """Encoding, length, pairs of equal signs (ordered), changes of class, and fit: three times the least p-value of a random string."""
    name, token = encoding(token)
    raw = np.frombuffer(token, np.uint8)
    at, size, n = _PLACES[name][raw], len(ALPHABETS[name]), len(token)
    counts = np.bincount(at)
    pairs = int(counts @ (counts - 1))
    kind = SIGN_CLASS[raw]
    changes = int(np.count_nonzero(kind[1:] != kind[:-1]))
    # chi-squared: mean and variance at this length; a scaled chi-squared of equal moments, by the cube root of its mean
    chi, mean, spread = size / n * (pairs + n) - n, size - 1.0, 2 * (size - 1) * (n - 1) / n
    scale, free = spread / (2 * mean), 2 * mean * mean / spread
    uniform = _normal((max(chi, 0.0) / (scale * free)) ** (1 / 3) / math.sqrt(2 / (9 * free)) - (1 - 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    rate = _RATES[name]
    single = len(set(SIGN_CLASS[list(_SETS[name])].tolist())) == 1
    halves = at >= size // 2
    seen = int(np.count_nonzero(halves[1:] != halves[:-1])) if single else changes
    run = _normal((seen - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)))
    off = at - at.mean()
    serial = _normal((float(off[:-1] @ off[1:]) / max(float(off @ off), 1e-9) + 1 / n) * math.sqrt(n))
    return name, n, pairs, changes, min(1.0, 3 * min(2 * min(p, 1 - p) for p in (uniform, run, serial)))


class Ordinary:
    """What ordinary text is like: frequencies of signs, per alphabet, and how often neighbours differ in class."""

    def __init__(self, tally: list[int]):
        counts = np.array(tally[:256], np.float64)
        self.rate = (tally[256] + 1) / (tally[257] + 2)
        self.moments = {}
        for name, letters in ALPHABETS.items():
            own = counts[list(letters.encode())] + 1
            own /= own.sum()
            self.moments[name] = float((own**2).sum()), float((own**3).sum())

    def p(self, name: str, n: int, pairs: int, changes: int) -> float:
        """Twice the lesser of two p-values of ordinary text: as few equal pairs, and as many changes of class."""
        if name == "decimal":
            return 1.0
        two, three = self.moments[name]
        mean, spread = n * (n - 1) * two, 2 * n * (n - 1) * (two - two * two) + 4 * n * (n - 1) * (n - 2) * (three - two * two)
        few = _normal((pairs - mean) / math.sqrt(spread)) if spread > 1e-9 else 1.0
        share = changes / (n - 1)
        far = share * math.log(share / self.rate) + ((1 - share) * math.log((1 - share) / (1 - self.rate)) if share < 1 else 0.0) if share > self.rate else 0.0
        return min(1.0, 2 * min(few, math.exp(-(n - 1) * far)))


_SPAN = "struct<start:bigint,place:int,kind:string,end:bigint>"
_CANDIDATE = "struct<start:bigint,end:bigint,encoding:string,n:bigint,pairs:bigint,changes:bigint,fit:double>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))),
    ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int64()), ("pairs", pa.int64()), ("changes", pa.int64()), ("fit", pa.float64())]))),
    ("tally", pa.list_(pa.int64())),
])
_READ = f"doc_id bigint, base array<{_SPAN}>, candidates array<{_CANDIDATE}>, tally array<bigint>"


def _base(texts: Texts, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order."""
    out = [(a, 2, b) for a, b in zip(*(x.tolist() for x in runs(texts, _HEX, HEX_LENGTH)), strict=True)]
    edges = texts.ends.tolist()
    for start, end in zip(edges, edges[1:], strict=False):
        text = raw[start:end]
        if b"AKIA" in text:
            out += [(start + m.start(), 1, start + m.end()) for m in ACCESS.finditer(text)]
        low = text.lower()
        if any(word in low for word in NEEDED):
            out += [(start + m.start(), 0, start + m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_LENGTH]
    return sorted(out)


def _free(spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the runs overlap none of the spans."""
    if not spans:
        return np.ones(starts.size, bool)
    first = np.array([s[0] for s in spans])
    reach = np.maximum.accumulate([s[2] for s in spans])
    before = np.searchsorted(first, ends, "left")  # spans that begin before the run ends
    return (before == 0) | (reach[np.maximum(before - 1, 0)] <= starts)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: base spans, candidates with their tests, and, on the last row of each slice of a batch, what its ordinary
    text holds: 256 counts of bytes, changes of class, and neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts.of(batch.column(1))
            raw = texts.data.tobytes()
            spans = _base(texts, raw)
            starts, ends = runs(texts, _ENCODED, MIN_LENGTH)
            kind = SIGN_CLASS[texts.data]
            both = (kind[1:] > 0) & (kind[:-1] > 0)
            both[texts.inner()[1:] - 1] = False
            differ = both & (kind[1:] != kind[:-1])
            counts = np.bincount(texts.data, minlength=256)
            changed, pairs = int(np.count_nonzero(differ)), int(np.count_nonzero(both))
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # all runs of candidates' length are not ordinary
                counts -= np.bincount(texts.data[a:b], minlength=256)
                changed -= int(np.count_nonzero(differ[a : b - 1]))
                pairs -= b - a - 1
            tally = [*counts.tolist(), changed, pairs]
            free = _free(spans, starts, ends)
            starts, ends = starts[free], ends[free]
            edges = np.array([[s[0], s[2]] for s in spans], np.int64).reshape(-1, 2)
            chars = code_points(texts)
            where = [np.searchsorted(texts.ends, at, "right") - 1 for at in (edges[:, 0], starts)]
            origin = chars.before(texts.ends[:-1]).tolist()
            base: list[list] = [[] for _ in range(batch.num_rows)]
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for r, s, (_, place, _), e in zip(where[0].tolist(), chars.before(edges[:, 0]).tolist(), spans, chars.before(edges[:, 1]).tolist(), strict=True):
                base[r].append({"start": s - origin[r], "place": place, "kind": KINDS[place], "end": e - origin[r]})
            for r, a, b, s in zip(where[1].tolist(), starts.tolist(), ends.tolist(), chars.before(starts).tolist(), strict=True):
                tested = dict(zip(("encoding", "n", "pairs", "changes", "fit"), battery(raw[a:b]), strict=True))
                found[r].append({"start": s - origin[r], "end": s - origin[r] + b - a} | tested)
            held = (base, found, [None] * (batch.num_rows - 1) + [tally])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _ARROW.types[k]) for k, x in enumerate(held, 1))], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _READ)


#: P-values are counted in steps of a sixteenth of a power of ten, rounded up.
STEPS, LAST_STEP = 16, 16 * 60


def judged(read: DataFrame, ordinary: Ordinary) -> DataFrame:
    """Each document's base spans, and its candidates with their length class (level) and the step of their p-value (0: one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("step", pa.int32())]))
        for batch in batches:
            rows = []
            for found in batch.column(2).to_pylist():
                rows.append([])
                for c in found:
                    p = 1.0 if c["fit"] < MIN_FIT else ordinary.p(c["encoding"], c["n"], c["pairs"], c["changes"])
                    level = sum(c["end"] - c["start"] >= x for x in CLASSES[1:])
                    rows[-1].append({"start": c["start"], "end": c["end"], "level": level, "step": min(LAST_STEP, int(-STEPS * math.log10(max(p, 1e-300))))})
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, kind)], names=["doc_id", "base", "found"])

    return read.select("doc_id", "base", "candidates").mapInArrow(run, f"doc_id bigint, base array<{_SPAN}>, found array<struct<start:bigint,end:bigint,level:int,step:int>>")


def limits(counted: list[tuple[int, int, int]], rate: float = FALSE_RATE) -> list[int]:
    """Of (class, step, number) rows: the least step of each class that is reported, by the step-up rule over its candidates."""
    out = []
    for level in range(len(CLASSES)):
        own = {s: n for k, s, n in counted if k == level}
        tests, above, least = sum(own.values()), 0, LAST_STEP + 1
        for s in sorted(own, reverse=True):
            above += own[s]
            if 10 ** (-s / STEPS) <= rate * above / tests:
                least = s
        out.append(least)
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """A row per document: ``base`` and all ``spans``, each (start, place, kind, end), by start, then kind as KINDS lists them. The scan is
    written (spans and candidates, no text); its sums go to the driver: 258 counts, and at most a number per length class and step."""
    read = materialise(scanned(docs), "secret-scan")
    sums = read.where("tally is not null").select(F.posexplode("tally").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    tally = [0] * 258
    for r in sums:
        tally[r["at"]] = r["n"]
    rows = judged(read, Ordinary(tally))
    counted = rows.select(F.explode("found").alias("c")).groupBy("c.level", "c.step").count().collect()
    least = F.array(*map(F.lit, limits([tuple(r) for r in counted], rate)))
    random = F.filter("found", lambda c: c.step >= F.get(least, c.level))
    random = F.transform(random, lambda c: F.struct(c.start.alias("start"), F.lit(3).alias("place"), F.lit(KINDS[3]).alias("kind"), c.end.alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """find_secrets as counts of the base kinds, a hash of the base spans, and all spans, each kind:start:end."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    rows = find_secrets(docs)
    of = lambda place: F.size(F.filter("base", lambda s: s.place == place)).cast("bigint")  # noqa: E731 - a second parameter would be the index
    counts = [of(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "*") -> Column:
    """The text with every sign inside a span replaced."""
    merged = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda done, s: F.struct(
        F.concat(done.out, F.substr(text, done.at + 1, F.greatest(s.start - done.at, F.lit(0))), F.repeat(F.lit(mask), F.greatest(s.end - F.greatest(s.start, done.at), F.lit(0)).cast("int"))).alias("out"),
        F.greatest(s.end, done.at).alias("at"),
    ))
    return F.concat(merged.out, F.substr(text, merged.at + 1))
