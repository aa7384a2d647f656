"""Operator 1: exact byte-level BPE encoding in linear time, and decoding by an offset table.

The encoder walks a text from left to right.  At each place an Aho-Corasick trie over the byte forms of the
vocabulary lists all tokens; the longest stays if it may stand behind the last one, which a table of
compatible pairs tells.  If not, shorter ones are tried, and at last the walk steps back over one token.
Places that proved dead are marked, so no place is tried twice.  The result is what merging by rank gives.

Two tokens a, b are compatible if merging the bytes of a+b by rank ends in exactly a, b.  The table is filled
on demand by undoing merges along the seam.

Cases: null counts as empty and gives no ids.  Texts and pretokens of any length are encoded whole: matches are listed
for ``WINDOW`` bytes at a time, the walk keeps some bytes for each token, and only short pretokens are stored.  Repeated
rows give repeated results; an empty table gives an empty one; other columns, of whatever names, are passed by.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm.common import map_texts, table, text_column

#: Fixed value: the pre-tokenizer's pattern, as the vocabulary's publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens that a worker keeps encoded, and letters of one at most; when the store is full it is emptied.
STORE, STORED_LETTERS = 150_000, 64
#: Bytes of a long pretoken whose matches are listed together.
WINDOW = 1 << 14
#: Judged pairs of tokens that a worker keeps, likewise.
PAIRS = 100_000
#: The same pattern for Python's own, faster matcher; it differs where a text holds digits that are not decimal,
#: separators U+001C to U+001F or letters of later Unicode versions, so it serves texts of these characters alone.
_QUICK = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7e\u00c0-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u201e]")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character; the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Store(dict):
    """Encoded pretokens; one that is missing is encoded, and a full store is emptied first."""

    def __init__(self, make):
        super().__init__()
        self.make, self.limit = make, STORE

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= STORED_LETTERS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = made
        return made


class Codec:
    """One vocabulary: ``encode`` and ``decode`` for whole texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes_of[i] = as_bytes(s)
        #: For each id its place in the order of merging, and the two ids that it is merged from.
        self.rank, self.parts, self.merged = [-1] * size, [None] * size, {}
        for k, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = whole
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = k, pair
        trie = ahocorasick.Automaton()
        self.id_of = {}
        for i, raw in enumerate(self.bytes_of):
            if raw:
                self.id_of[raw] = i
                trie.add_word(raw.decode("latin-1"), i)
        trie.make_automaton()
        self.trie, self.sizes = trie, [len(raw) for raw in self.bytes_of]
        self.longest = max(self.sizes)
        # decoding: all token bytes one after another, and where each starts
        self.offsets = np.zeros(size + 1, np.int64)
        tokens = [*self.bytes_of]
        for s, i in self.special.items():
            tokens[i] = s.encode()
        np.cumsum([len(t) for t in tokens], out=self.offsets[1:])
        self.store = np.frombuffer(b"".join(tokens), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.as_ids = _Store(lambda w: np.array(self.encode_word(w.encode()), np.int32).tobytes())
        self.names = [str(i) for i in range(size)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank ends in a, b."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        left, right, limit, fits = a, b, float("inf"), True
        rank, parts = self.rank, self.parts
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and rank[whole] < limit:
                fits = False  # this merge comes before one that a or b needs
                break
            # undo the later of the two merges at the seam: on a tie the left one came first
            if rank[left] > rank[right]:
                limit, left = rank[left], parts[left][1]
            elif parts[right] is not None:
                limit, right = rank[right] + 1, parts[right][0]
            else:
                break
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def encode_word(self, raw: bytes) -> list[int]:
        """The ids of one pretoken."""
        if (whole := self.id_of.get(raw)) is not None and self._reached(whole):
            return [whole]
        end, sizes, pairs = len(raw), self.sizes, self.pairs
        word = raw.decode("latin-1")
        starts = self._matches_within(word, 0, end).__getitem__ if end <= WINDOW else self._matches(word)
        # for each token of the walk how many of the matches at its place are still untried
        out: list[int] = []
        at, alive, tokens = 0, bytearray(b"\1") * (end + 1), starts(0)
        left = [len(tokens)]
        while True:
            some = left[-1]
            while some:
                some -= 1
                token = tokens[some]
                if alive[at + sizes[token]]:
                    if not out:
                        break
                    fits = pairs.get((out[-1], token))
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                    if fits:
                        break
            else:
                alive[at] = 0
                left.pop()
                at -= sizes[out.pop()]
                tokens = starts(at)
                continue
            left[-1] = some
            out.append(token)
            at += sizes[token]
            if at == end:
                return out
            tokens = starts(at)
            left.append(len(tokens))

    def _matches_within(self, word: str, lo: int, hi: int) -> list[list[int]]:
        """All tokens that start at each place from lo to hi, shorter ones first: they come in the order of their ends."""
        sizes, found = self.sizes, [[] for _ in range(hi - lo)]
        for last, token in self.trie.iter(word, lo, min(hi + self.longest, len(word))):
            first = last + 1 - sizes[token]
            if first < hi:
                found[first - lo].append(token)
        return found

    def _matches(self, word: str):
        """A function of a place of a long pretoken to the tokens that start there, which holds three windows at most."""
        windows: dict[int, list[list[int]]] = {}

        def at(place: int) -> list[int]:
            w, k = divmod(place, WINDOW)
            if w not in windows:
                if len(windows) > 2:  # a step back may need the window before
                    del windows[max(windows, key=lambda v: abs(v - w))]
                windows[w] = self._matches_within(word, w * WINDOW, min((w + 1) * WINDOW, len(word)))
            return windows[w][k]

        return at

    @functools.lru_cache(maxsize=None)  # noqa: B019  one entry for a vocabulary item at most
    def _reached(self, token: int) -> bool:
        """Whether merging by rank reaches this token from its bytes (a vocabulary may hold others)."""
        if self.parts[token] is None:
            return True
        a, b = self.parts[token]
        limit, fits = self.rank[token], True
        left, right = a, b
        while fits:
            if rank_ok := max(self.rank[left], self.rank[right]) >= 0:
                if self.rank[left] > self.rank[right]:
                    step, left = self.rank[left], self.parts[left][1]
                else:
                    step, right = self.rank[right] + 1, self.parts[right][0]
                whole = self.merged.get((left, right))
                fits = step <= limit and not (whole is not None and self.rank[whole] < step)
            if not rank_ok:
                break
        return fits and self._reached(a) and self._reached(b)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a whole text, as an array and joined by commas."""
        joined, raw = [], []
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                joined.append(str(self.special[part]))
                raw.append(np.int32(self.special[part]).tobytes())
            elif part:
                pattern = self.pattern if _OTHER.search(part) else _QUICK
                for words in self._words(pattern, part):
                    some = b"".join(map(self.as_ids.__getitem__, words))
                    raw.append(some)
                    joined.append(",".join(map(self.names.__getitem__, np.frombuffer(some, np.int32).tolist())))
        return np.frombuffer(b"".join(raw), np.int32), ",".join(joined)

    @staticmethod
    def _words(pattern, part: str) -> Iterator[list[str]]:
        """The pretokens of a text; those of a giant one in several lists, so that they never all exist at once."""
        if len(part) < 2_000_000:
            yield pattern.findall(part)
            return
        words: list[str] = []
        for m in pattern.finditer(part):
            words.append(m[0])
            if len(words) == 100_000:
                yield words
                words = []
        if words:
            yield words

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the offset table."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        sizes = self.offsets[ids + 1] - start
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1])
        at += np.repeat(start - (ends - sizes), sizes)
        return self.store[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file; a worker keeps it between tasks."""
    return Codec(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A path as it is; of a bare name the place among the public vocabularies installed where this runs."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", columns: tuple[str, ...] = ("doc_id",), text: str = "text", store: int = STORE) -> DataFrame:
    """``columns`` of each document, its token ids and digests of the ids and of the decoded text.

    Result columns: columns..., n_tokens, ids_sha256, decoded_sha256, ids (array of int).  Null texts count as empty.
    ``vocabulary``: a path, or the name of a public vocabulary, which each task looks up where it runs.
    ``store``: pretokens that a worker keeps encoded, some 200 bytes each; more cost memory and save time.
    """
    kept = docs.select(*columns, text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        own.as_ids.limit = store
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, all_ids, shas, back = [0], [], [], []
                for t in text_column(part.column(len(columns))).to_pylist():
                    ids, joined = own.encode(t)
                    counts.append(len(ids))
                    all_ids.append(ids)
                    shas.append(hashlib.sha256(joined.encode()).hexdigest())
                    raw = own.decode_bytes(ids)
                    if t.encode("utf-8", "replace") != raw:
                        raw = raw.decode("utf-8", "replace").encode()
                    back.append(hashlib.sha256(raw).hexdigest())
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate(all_ids), pa.int32()))
                out = [*part.columns[: len(columns)], pa.array(counts[1:], pa.int64()), pa.array(shas), pa.array(back), ids]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return map_texts(kept, run, schema)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, store=400_000).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
