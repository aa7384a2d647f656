"""Operator 4: secret scans.

Base rules find assignments, access keys and long hexadecimal runs by pattern.  The method adds other runs of
``[A-Za-z0-9+/_=-]`` of at least ``LEAST`` characters that look random: two Markov models over pairs of neighbouring
characters, one of random strings and one of ordinary words and identifiers, are compared by log-likelihood ratio.

Both models and the thresholds are learnt from labelled runs of all texts; equal texts are learnt from once, so that copies do not
outweigh the rest.  Ordinary are words and numbers beside the base matches (runs of letters or of digits alone), and names that
neighbouring words of a document would make: with capitals, underscores, hyphens, slashes, numbers.  Runs that mix letters
and digits are not learnt from, as secrets may be among them.  Random are the values of base matches, and as many strings drawn by a
hash from each usual alphabet.  One half of the texts, told by hash, gives the models.  On the other half the mean ratios of its
ordinary runs are counted by class of length: a run is random if its mean ratio lies ``MARGIN`` above what all but one in
``RARE`` ordinary runs of its length reach, and if its ratio outweighs the odds against a secret (``TOTAL``).

Cases: null and empty texts have no spans.  Texts of any length are learnt from and scanned whole, in time that grows with the text;
names are made within stretches of about ``STRETCH`` characters.
Positions count code points; ends are exclusive.  Added spans touch no base span.  Repeated rows give repeated results; an
empty table gives an empty one, and a model learnt from it knows the drawn strings alone and adds nothing.  Other columns,
of whatever names, are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import map_texts, quoted, table, text_column

#: The base patterns and the lengths below which their matches drop.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

LEAST = 12
GENERATED = 2000
#: Characters of texts whose ordinary runs are held together, about.
STRETCH = 1 << 18
#: Nats that a run's ratio must exceed in total: the odds against a run being a secret.
TOTAL = 11.5
#: Nats per pair of characters above the ordinary runs' threshold, and how rare an ordinary run beyond that is.
MARGIN, RARE = 0.1, 100_000
#: Lengths where a class of lengths begins, after the first.
LENGTHS = (16, 20, 28)
#: Width of a bin of mean ratios, and bins on each side of zero.
BIN, BINS = 0.02, 1000
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_LETTERS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])")
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z][a-z]{7,}|[A-Z]{8,}|[0-9]{8,})(?![A-Za-z0-9+/_=-])")
_BREAK = re.compile("[^A-Za-z0-9+/_=-]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
SIDE = len(_ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def pair_counts(runs: list[str]) -> np.ndarray:
    """How often each character follows each other within runs."""
    out = np.zeros(SIDE * SIDE, np.int64)
    for at in range(0, len(runs), 5000):
        codes = _CODE[np.frombuffer("\x00".join(runs[at : at + 5000]).encode("ascii", "replace"), np.uint8) & 127]
        ends = np.frombuffer("\x00".join(runs[at : at + 5000]).encode("ascii", "replace"), np.uint8) == 0
        inside = ~(ends[:-1] | ends[1:])
        out += np.bincount((codes[:-1] * SIDE + codes[1:])[inside], minlength=SIDE * SIDE)
    return out


#: Base 32 leaves out four digits: letters stand in for them.
_FULL = str.maketrans("IOLB", "0189")


def random_runs() -> list[str]:
    """Strings drawn by a hash, of 12 to 40 characters, in the usual alphabets of keys: base64, base64 for URLs, letters and digits of both cases or of one, hexadecimal of either case."""
    out = []
    for i in range(GENERATED):
        raw, n = hashlib.sha256(b"random %d" % i).digest(), LEAST + i % 29
        plain = base64.b64encode(raw + raw[:8]).decode()
        out += [plain[:n], base64.urlsafe_b64encode(raw + raw[::-1]).decode()[:n], re.sub("[+/=]", "", plain)[:n], raw.hex()[:n], raw.hex().upper()[:n]]
        one = base64.b32encode(raw).decode().translate(_FULL)[:n]
        out += [one, one.lower()]
    return out


def names(text: str) -> list[str]:
    """Names as programs have them, made of two to five neighbouring words of a text, in turn in the usual manners."""
    words, out, at = [w.lower() for w in _LETTERS.findall(text)], [], 0
    while at < len(words) - 1:
        k = len(out)
        some = words[at : at + 2 + k % 4]
        at += len(some)
        big = [w.capitalize() for w in some]
        out.append((
            some[0] + "".join(big[1:]), "".join(big), "_".join(some), "_".join(some).upper(), "-".join(some), "/".join(some) + big[0],
            f"{2000 + k % 40}-{1 + k % 12:02d}-{1 + k % 28:02d}-{some[0]}_{k % 100}", f"{some[0]}{big[1]}{k % 1000}={some[-1]}+{k % 10}",
        )[k // 4 % 8])
    return out


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans that come sorted by start."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def outside(text: str, base: list[tuple[int, int, str]]) -> list[str]:
    """The stretches of a text between its base spans."""
    starts, ends = merged(base)
    return [text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)]


def stretches(text: str, base: list[tuple[int, int, str]]) -> Iterator[str]:
    """What lies outside the base spans, long parts in pieces that end between runs."""
    for part in outside(text, base):
        at = 0
        while at < len(part):
            gap = _BREAK.search(part, at + STRETCH)
            end = gap.start() if gap else len(part)
            yield part[at:end]
            at = end


def labelled_runs(texts: Iterable[str]) -> Iterator[tuple[list[str], list[str]]]:
    """Ordinary runs and the values of base matches, in lists from about ``STRETCH`` characters of texts each."""
    plain, found, held = [], [], 0
    for t in texts:
        spans = base_spans(t)
        found += [t[a:b] if kind != "assign" else ASSIGN.match(t, a)[2] for a, b, kind in spans]
        for piece in stretches(t, spans):
            plain += _ORDINARY.findall(piece)
            plain += names(piece)
            held += len(piece)
            if held >= STRETCH:
                yield plain, found
                plain, found, held = [], [], 0
    yield plain, found


def length_class(sizes: np.ndarray) -> np.ndarray:
    """The class of each length."""
    return np.searchsorted(LENGTHS, sizes, side="right")


@dataclass
class Model:
    """Log-likelihood ratio of each pair of characters, and for each class of lengths the mean ratio above which a run is random."""

    ratio: np.ndarray
    threshold: np.ndarray

    def ratios(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Total ratio and length of each run."""
        raw = np.frombuffer("\x00".join(runs).encode("ascii", "replace"), np.uint8)
        codes = _CODE[raw & 127]
        pairs = self.ratio[codes[:-1] * SIDE + codes[1:]]
        pairs[(raw[:-1] == 0) | (raw[1:] == 0)] = 0.0
        sums = np.concatenate([[0.0], np.cumsum(pairs)])
        sizes = np.array([len(r) for r in runs])
        ends = np.cumsum(sizes + 1) - 2
        return sums[ends] - sums[ends - sizes + 1], sizes

    def random(self, runs: list[str]) -> np.ndarray:
        """Whether each run looks random."""
        total, sizes = self.ratios(runs)
        return (total > TOTAL) & (total / (sizes - 1) > self.threshold[length_class(sizes)])

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The random runs of a text that touch no base span."""
        runs = [m.span() for m in _RUN.finditer(text)]
        if runs and base:
            starts, ends = merged(base)
            before = np.searchsorted(starts, [b for _, b in runs]) - 1  # the last stretch that begins before the run's end
            runs = [r for r, k in zip(runs, before.tolist(), strict=True) if k < 0 or ends[k] <= r[0]]
        if not runs:
            return []
        return [(a, b, "random") for (a, b), found in zip(runs, self.random([text[a:b] for a, b in runs]).tolist(), strict=True) if found]


def _pair_model(rows: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair, from the texts of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, secret = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
        for batch in batches:
            for plain, found in labelled_runs(text_column(batch.column(0)).to_pylist()):
                ordinary += pair_counts(plain)
                secret += pair_counts(found)
        at = np.flatnonzero(ordinary + secret)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ordinary[at]), pa.array(secret[at])], names=["pair", "ordinary", "secret"])

    counted = map_texts(rows, run, "pair bigint, ordinary bigint, secret bigint").groupBy("pair").agg(F.sum("ordinary").alias("ordinary"), F.sum("secret").alias("secret")).collect()
    ordinary, secret = np.ones(SIDE * SIDE), np.ones(SIDE * SIDE)
    for r in counted:
        ordinary[r["pair"]] += r["ordinary"]
        secret[r["pair"]] += r["secret"]
    generated = pair_counts(random_runs()).astype(float)
    secret += generated * max(1.0, secret.sum() / generated.sum())
    log = lambda m: np.log(m.reshape(SIDE, SIDE) / m.reshape(SIDE, SIDE).sum(axis=1, keepdims=True)).ravel()
    return log(secret) - log(ordinary)


def thresholds(counts: np.ndarray) -> np.ndarray:
    """From counts of ordinary runs (length class, bin of mean ratio): the mean ratio that all but one in RARE stay below, and MARGIN.

    A class with few ordinary runs has at least the threshold of the longer one, as means of few pairs spread more.
    """
    out, least = np.zeros(len(counts)), 0.0
    for k in range(len(counts) - 1, -1, -1):
        if counts[k].sum():
            beyond = counts[k][::-1].cumsum()[::-1]  # runs in this bin or a higher one
            top = int(np.flatnonzero(beyond > counts[k].sum() / RARE).max(initial=0))
            least = max(least, (top + 1 - BINS) * BIN)
        out[k] = least + MARGIN
    return out


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model from all texts of docs, equal ones once; other columns do not matter."""
    texts = docs.select(F.col(quoted(text)).alias("text")).where("text <> ''")
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)) == 0
    model = Model(_pair_model(texts.where(half).distinct()), np.zeros(len(LENGTHS) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LENGTHS) + 1) * 2 * BINS, np.int64)
        for batch in batches:
            for plain, _ in labelled_runs(text_column(batch.column(0)).to_pylist()):
                if runs := [r for r in plain if len(r) >= LEAST]:
                    total, sizes = model.ratios(runs)
                    bins = np.clip(np.floor(total / (sizes - 1) / BIN).astype(int) + BINS, 0, 2 * BINS - 1)
                    counts += np.bincount(length_class(sizes) * 2 * BINS + bins, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])

    counts = np.zeros((len(LENGTHS) + 1) * 2 * BINS, np.int64)
    for r in map_texts(texts.where(~half).distinct(), run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    if not counts.any():
        return Model(model.ratio, np.full(len(LENGTHS) + 1, np.inf))  # nothing ordinary to tell random from
    return Model(model.ratio, thresholds(counts.reshape(len(LENGTHS) + 1, -1)))


def scan(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``columns`` of each row and its spans: found (array of kind, start, end), by start, then kind as listed."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "found array<struct<kind: string, start: int, end: int>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for t in text_column(part.column(len(columns))).to_pylist():
                    base = base_spans(t)
                    spans = sorted([*base, *model.spans(t, base)], key=lambda x: (x[0], KINDS.index(x[2])))
                    out.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(out, kind)], names=[*columns, "found"])

    return map_texts(docs.select(*columns, text), run, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
