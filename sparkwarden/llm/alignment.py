"""Operator 12: where two tokenizers cut the same text alike, and which of their tokens stand for each other.

Both token sequences of a text are lists of byte offsets at which tokens end.  Their common offsets are found by a galloping
intersection: each end of the shorter list drives an exponential and then a binary search into the longer one, from where the last
search stopped.  Common offsets cut both sequences into groups; within them the tokens whose byte ranges overlap are a range of
ranks, from the rank of a token's start to that of its end.

Neither tokenizer joins a blank, or what is no letter, to a letter before it (``Pair`` checks this on its pieces; the pattern of the other
cuts there), so a text is cut in front of runs of blanks and behind runs of letters, and every distinct chunk is encoded and aligned once
while it stays in a worker's bounded store.  Texts with characters beyond European ones are cut at blanks alone; those with other
characters that separate words, and all texts if the pieces fail the check, are aligned whole.

Texts are aligned once, and the links of each document are kept beside its numbers as packed pairs of ids.  Counts of id pairs take two
passes over those.  The first counts them in each task.  At most ``KNOWN`` pairs can make up more than a ``KNOWN``-th of all links: those
are broadcast, and the second pass sums their counts by document.  What a document links beyond them is joined to the counts by shuffle.

Cases: null and empty texts, and those whose tokens do not spell them (with the space before), have no tokens and get zeros and
an empty digest.  Texts of any length are aligned whole.  Repeated rows count as often as they stand there and get a row each.  Of
pairs that are equally frequent for an id of the second tokenizer all are best.  An empty table gives an empty one.  Other columns, of whatever
names, are passed by; those asked for must not be named as those of the result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.bpe import PATTERN, codec, vocabulary_path
from sparkwarden.llm.common import cut, map_texts, table, text_column

#: Pairs of ids whose counts are broadcast at most: 9 MB.
KNOWN = 1 << 19
#: Aligned chunks that a worker keeps in each of two generations, and letters of one at most.
STORE, STORED_LETTERS = 400_000, 48
#: Bytes of links that a task looks at together, about; those of a longer text are looked at alone.
LINK_BYTES = 1 << 22
#: Links are packed into 4 bytes where all ids have 16 bits, else into 8.
PACKED = {16: "I", 32: "q"}
_BLANKS, _LETTERS = " \t\n\x0b\x0c", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Chunks begin with blanks and end before the next; finer ones also end behind letters.
_CHUNKS = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+")
_FINE = re.compile(f"[{_BLANKS}]*(?:[^{_BLANKS}{_LETTERS}]*[{_LETTERS}]+|[^{_BLANKS}{_LETTERS}]+)|[{_BLANKS}]+")
#: Other characters that one of the tokenizers takes for a blank or joins to what stands before.
_OTHER_BLANKS = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
#: Characters that may be letters or belong to one.
_OTHER = re.compile(f"[^\x00-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7{_LETTERS[6:]}\u2010-\u2027]")


class Aligned(NamedTuple):
    """A chunk: tokens of either kind, groups, the groups spelled out, and its packed links."""

    n_a: int
    n_b: int
    n_groups: int
    spelled: str
    links: bytes


def gallop(short: Sequence[int], long: Sequence[int]) -> list[tuple[int, int]]:
    """Ranks (in short, in long) of what two increasing lists have in common; the shorter one drives."""
    found, low, size = [], 0, len(long)
    for rank, value in enumerate(short):
        step, high = 1, low
        while high < size and long[high] < value:
            low, high = high + 1, high + step
            step *= 2
        low = bisect_left(long, value, low, min(high, size))
        if low == size:
            break
        if long[low] == value:
            found.append((rank, low))
            low += 1
    return found


def align(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int], names_a: Sequence[str], names_b: Sequence[str], shift: int = 32) -> Aligned:
    """The groups and links (a << shift | b) of two token sequences over the same bytes; ``names``: the ids in decimal."""
    common = gallop(ends_a, ends_b) if len(ends_a) <= len(ends_b) else [(i, j) for j, i in gallop(ends_b, ends_a)]
    spelled, links, from_a, from_b = [], [], 0, 0
    for last_a, last_b in common:
        if last_a == from_a and last_b == from_b:
            a, b = ids_a[from_a], ids_b[from_b]
            spelled.append(f"{names_a[a]}|{names_b[b]}")
            links.append(a << shift | b)
        else:
            own_a, own_b = ids_a[from_a : last_a + 1], ids_b[from_b : last_b + 1]
            spelled.append(f"{','.join([names_a[a] for a in own_a])}|{','.join([names_b[b] for b in own_b])}")
            if last_a == from_a or last_b == from_b:
                links += [a << shift | b for a in own_a for b in own_b]
            else:
                start = ends_a[from_a - 1] if from_a else 0
                for k, a in enumerate(own_a):
                    end = ends_a[from_a + k]
                    # tokens of the other kind that end behind this one's start, up to the first that ends at or behind its end
                    first = bisect_right(ends_b, start, from_b, last_b + 1)
                    last = bisect_left(ends_b, end, first, last_b + 1)
                    links += [a << shift | b for b in ids_b[first : last + 1]]
                    start = end
        from_a, from_b = last_a + 1, last_b + 1
    return Aligned(len(ids_a), len(ids_b), len(spelled), ";".join(spelled), array(PACKED[shift], links).tobytes())


def _token_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Pair:
    """Two tokenizers, and the chunks that were aligned last."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = codec(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = _token_bytes(self.b)
        self.names_a, self.names_b = [str(i) for i in range(len(self.a.bytes_of))], [str(i) for i in range(len(self.bytes_b))]
        self.shift = 16 if max(len(self.names_a), len(self.names_b)) <= 1 << 16 else 32
        # where ids are in the order of merging they are ranks, and a compiled encoder gives the same ids for chunks
        ranks = {raw: i for i, raw in enumerate(self.a.bytes_of) if raw}
        merges = [i for i, r in sorted(enumerate(self.a.rank), key=lambda x: x[1]) if r >= 0]
        ordered = merges == sorted(merges) and all(len(raw) > 1 or i < merges[0] for raw, i in ranks.items())
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None
        self.sizes_a, self.sizes_b = [len(t) for t in self.a.bytes_of], [len(t) for t in self.bytes_b]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        inside = lambda pattern: any(re.search(pattern, p) for p in pieces)
        #: Whether no piece has a blank, or else what is no letter, behind a letter or mark.
        self.cuts = not inside(f"[^▁{_BLANKS}][▁{_BLANKS}]")
        self.fine = self.cuts and not inside(f"[{_LETTERS}][^{_LETTERS}]")
        self.before = self.b.encode("a")
        self.store: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def chunks(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers cut whatever stands around."""
        text = f" {text}"
        if not self.cuts or _OTHER_BLANKS.search(text):
            return [text]
        return (_FINE if self.fine and not _OTHER.search(text) else _CHUNKS).findall(text)

    def ids_a(self, chunk: str) -> list[int]:
        if self.quick is not None:
            return self.quick(chunk)
        return array("i", b"".join(map(self.a.as_ids.__getitem__, self.a.pattern.findall(chunk)))).tolist()

    def made(self, chunks: list[str]) -> list[Aligned | None]:
        """Each chunk aligned; None where its tokens do not spell it."""
        # the model puts a blank before each: instead of the chunk's own, or before a letter that goes again
        all_b = self.b.encode([c[1:] if c[0] == " " and c != " " else f"a{c}" for c in chunks], num_threads=1)
        out: list[Aligned | None] = []
        for chunk, ids_b in zip(chunks, all_b, strict=True):
            if chunk[0] != " " or chunk == " ":
                if ids_b[: len(self.before)] != self.before:
                    out.append(None)
                    continue
                del ids_b[: len(self.before)]
            ids_a, raw = self.ids_a(chunk), chunk.encode("utf-8", "surrogatepass")
            # a compiled encoder over all bytes always spells its text
            if b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw or self.quick is None and b"".join(map(self.a.bytes_of.__getitem__, ids_a)) != raw:
                out.append(None)
                continue
            out.append(align(ids_a, list(accumulate(map(self.sizes_a.__getitem__, ids_a))), ids_b, list(accumulate(map(self.sizes_b.__getitem__, ids_b))), self.names_a, self.names_b, self.shift))
        return out

    def of(self, chunks: list[str]) -> dict[str, Aligned | None]:
        """A table that holds all these chunks."""
        store, older = self.store, self.older
        missing = [c for c in dict.fromkeys(chunks) if c not in store]
        if not missing:
            return store
        got = {c: older[c] for c in missing if c in older}
        if len(got) < len(missing):
            missing = [c for c in missing if c not in got]
            got.update(zip(missing, self.made(missing), strict=True))
        store.update({c: x for c, x in got.items() if len(c) <= STORED_LETTERS})
        known = store if max(map(len, got)) <= STORED_LETTERS else _Both(store, got)
        if len(store) > STORE:
            self.older, self.store = store, {}
        return known

    def text(self, text: str) -> list[Aligned] | None:
        """The chunks of a text, aligned; None if it has no tokens."""
        chunks = self.chunks(text) if text else []
        if not chunks:
            return None
        try:
            found = list(map(self.store.__getitem__, chunks))
        except KeyError:
            found = list(map(self.of(chunks).__getitem__, chunks))
        if None in found:
            # the text as a whole may still be spelled
            return found if len(chunks) > 1 and None not in (found := self.made([f" {text}"])) else None
        return found


class _Both(dict):
    """What is in ``more``, else in the store."""

    def __init__(self, store: dict, more: dict):
        super().__init__(more)
        self.store = store

    def __missing__(self, chunk: str):
        return self.store[chunk]


@functools.lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """The tokenizers of two vocabulary files; a worker keeps them between tasks."""
    return Pair(path_a, path_b)


def packed_links(links: pa.Array, counts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``LINK_BYTES``, of links and the number of each row's: first row, end, links as stored, and offsets of each row's."""
    links = links.cast(pa.binary())
    offs = np.frombuffer(links.buffers()[1], np.int32, len(links) + 1, links.offset * 4).astype(np.int64)
    raw = np.frombuffer(links.buffers()[2] or b"", np.uint8)
    total, at = sum(counts.to_pylist()), 0
    kind = np.dtype(np.int64 if total and (offs[-1] - offs[0]) // total == 8 else np.uint32)
    while at < len(links):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + LINK_BYTES, side="right")) - 1)
        yield at, end, np.frombuffer(raw[offs[at] : offs[end]].tobytes(), kind), (offs[at : end + 1] - offs[at]) // kind.itemsize
        at = end


def as_pairs(links: np.ndarray) -> np.ndarray:
    """Links as stored to pairs a << 32 | b, in the same order."""
    if links.dtype == np.int64:
        return links
    return links.astype(np.int64) >> 16 << 32 | links & 0xFFFF


def align_texts(docs: DataFrame, path_a: str, path_b: str, columns: Sequence[str], text: str, with_groups: bool) -> DataFrame:
    """``columns`` of each document, n_a, n_b, n_groups, n_links, groups_sha256, with_groups groups, and __links (binary, packed)."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    names = ["n_a", "n_b", "n_groups", "n_links"]
    last = ["groups_sha256", *(["groups"] if with_groups else []), "__links"]
    schema = ", ".join([*fields, *(f"{n} bigint" for n in names), *(f"{n} {'binary' if n == '__links' else 'string'}" for n in last)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(vocabulary_path(path_a), vocabulary_path(path_b))
        width = array(PACKED[own.shift]).itemsize

        def made(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            *numbers, shas, spelled, links = zip(*rows, strict=True)
            texts = [pa.array(shas, pa.string()), *([pa.array(spelled, pa.string())] if with_groups else []), pa.array(links, pa.binary())]
            return pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(n, pa.int64()) for n in numbers), *texts], names=[*columns, *names, *last])

        for batch in batches:
            at, rows, held = 0, [], 0
            for t in text_column(batch.column(len(columns))).to_pylist():
                found = own.text(t)
                if found is None:
                    rows.append((0, 0, 0, 0, "", "", b""))
                else:
                    n_a, n_b, n_groups, spelled, links = zip(*found, strict=True)
                    groups, links = ";".join(spelled), b"".join(links)
                    rows.append((sum(n_a), sum(n_b), sum(n_groups), len(links) // width, hashlib.sha256(groups.encode()).hexdigest(), groups if with_groups else "", links))
                    held += len(links)
                if held > LINK_BYTES:
                    yield made(batch.slice(at, len(rows)), rows)
                    at, rows, held = at + len(rows), [], 0
            if rows:
                yield made(batch.slice(at, len(rows)), rows)

    return map_texts(docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").alias("__text")), run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n) of ``align_texts``: for each pair of ids a << 32 | b how many links hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[np.ndarray] = []

        def handed() -> Iterator[pa.RecordBatch]:
            if some:
                keys, counts = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_pairs(keys)), pa.array(counts)], names=["pair", "n"])
                some.clear()

        for batch in batches:
            for _, _, links, _ in packed_links(batch.column(0), batch.column(1)):
                some.append(links)
                if sum(x.nbytes for x in some) > 2 * LINK_BYTES:
                    yield from handed()
        yield from handed()

    return map_texts(aligned.where("n_links > 0").select("__links", "n_links"), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str = "byte_bpe_50k.json", path_b: str = "piece_bpe_32k.model", columns: Sequence[str] = ("doc_id",), text: str = "text", known_pairs: int = KNOWN, with_groups: bool = False) -> DataFrame:
    """``columns`` of each document and the alignment of its two token sequences.

    Result columns: columns..., n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256, and ``with_groups`` groups (``a1,a2|b1;a3|b2,b3``).
    ``path_a``, ``path_b``: paths, or names of public vocabularies, which each task looks up where it runs.
    """
    spark = docs.sparkSession
    aligned = cut(align_texts(docs, path_a, path_b, columns, text, with_groups))
    counted = cut(link_counts(aligned))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # one row an id of the second vocabulary: as many as it has at most
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    counts = cut(counted.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * known_pairs >= total)  # known_pairs at most, as they share the total
    held = often.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((held["pair"].to_numpy(), held["n"].to_numpy(), held["best"].to_numpy(zero_copy_only=False)))

    kept = aligned.columns[:-1]  # without the links
    weights = {"n_best": "bigint", "count_sum": "bigint", "rest": "array<bigint>"}
    schema = ", ".join([*(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {kind}" for c, kind in weights.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ns, bests = shared.value
        # as links are stored, and behind them an entry for those that are not among them
        stored = {x.dtype: np.append(x, x.dtype.type(0)) for x in (pairs, (pairs >> 32 << 16 | pairs & 0xFFFF).astype(np.uint32))}
        ns, bests = np.append(ns, 0), np.append(bests, False)
        for batch in batches:
            for at, end, links, offs in packed_links(batch.column(len(kept)), batch.column(len(columns) + 3)):
                known = stored[links.dtype]
                place = np.searchsorted(known[:-1], links)
                place[known[place] != links] = len(pairs)
                lone = place == len(pairs)
                sums = [np.concatenate([[0], np.cumsum(x)])[offs] for x in (bests[place], ns[place], lone)]
                rest = pa.ListArray.from_arrays(pa.array(sums[2], pa.int32()), pa.array(as_pairs(links[lone])))
                own = [pa.array(np.diff(x)) for x in sums[:2]]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns[: len(kept)], *own, rest], names=[*kept, *weights])

    out = _with_rest(map_texts(aligned, run, schema), counts.where(F.col("n") * known_pairs < total), columns)
    return out.select(*(F.col(f"`{c}`") for c in columns), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))


def _with_rest(rows: DataFrame, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with what the pairs in ``rest`` add to n_best and count_sum."""
    first = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    left = first.select("__row", F.explode("rest").alias("pair")).groupBy("__row", "pair").agg(F.count("*").alias("times")).join(counts, "pair")
    added = left.groupBy("__row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    out = first.drop("rest").join(added, "__row", "left")
    plus = {"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))}
    return out.withColumns(plus).drop("__row", "__best", "__sum")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, its byte-level tokens aligned with its pieces."""
    out = align_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
