"""BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many distinct words lie in one flat array.  A round looks up every pair of
neighbours by binary search over the sorted pair keys, takes each word's lowest rank and
merges all its places at once (in a run such as ``a a a``, every other from the left);
words with no pair left are done.  Words and their pieces are kept for later texts of the same task: the
last ``CACHE`` of each, and those met since.

A null text is encoded as an empty one: no ids, and an empty text decoded from them.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Distinct words, and pieces, whose ids a task keeps (twice as many at most, with those before them); and new words merged at a time.
CACHE = 250_000
BATCH = 30_000
_NONE = np.int64(1 << 40)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class WordBpe:
    """A word-end BPE of a tokenizers file: normalised words, byte symbols, ranked merges."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.end] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        library = Tokenizer.from_file(path)
        self.normal, self.rule = library.normalizer, library.pre_tokenizer
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces, self.lined = regex.compile(rule), regex.compile(rf"\n|{rule}")
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, given as its bytes, as little-endian 32-bit numbers."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        out = [b""] * len(words)
        live = np.arange(len(words))
        while len(live):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                keep = np.repeat(~done, size)
                ids, to = sym[~keep].astype("<i4").tobytes(), np.cumsum(size[done]) * 4
                for w, i, j in zip(live[done].tolist(), [0, *to.tolist()], to.tolist(), strict=False):
                    out[w] = ids[i:j]
                sym, rank, live, size, low = sym[keep], rank[keep], live[~done], size[~done], low[~done]
                if not len(live):
                    break
            word = np.repeat(np.arange(len(live)), size)
            at = np.flatnonzero(rank == low[word])
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1] + 1
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = size - np.bincount(word[at], minlength=len(live))
            now = at - np.arange(len(at))
            sym, rank = sym[keep], rank[keep]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            first_of = np.zeros(len(sym) + 1, bool)
            first_of[np.cumsum(size) - size] = True
            right = now[~last[now]]
            rank[right] = self.ranks(sym[right], sym[right + 1])
            rank[now[last[now]]] = _NONE
            before = now[~first_of[now]] - 1
            rank[before] = self.ranks(sym[before], sym[before + 1])
        return out

    def _pieces(self, part: str) -> list[str]:
        if max(part, default="") > "\u024f":  # where Unicode tables of other versions can differ, the library's own
            part = self.normal.normalize_str(part)
            return [part[i:j] for _, (i, j) in self.rule.pre_tokenize_str(part)]
        return self.pieces.findall(unicodedata.normalize("NFC", part).lower())

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new words without white space."""
        special = {k: v.to_bytes(4, "little") for k, v in self.special.items()}
        for i in range(0, len(words), BATCH):
            # plain words are split as one text, a word a line; those for the library or with special tokens each for itself
            batch, hard = words[i : i + BATCH], {}
            lines = "\n".join([*batch, ""])
            if _HARD.search(lines):
                hard = {w: [special.get(x) or self._pieces(x) for x in self.split.split(w)] for w in batch if _HARD.search(w)}
                batch = [w for w in batch if w not in hard]
                lines = "\n".join([*batch, ""])
            found = self.lined.findall((lines if lines.isascii() else unicodedata.normalize("NFC", lines)).lower())
            if len(self.parts) > CACHE:
                self.parts = {}
            have = self.parts
            have["\n"] = b""
            new = list(set(found).union(*(x for parts in hard.values() for x in parts if isinstance(x, list))).difference(have))
            if new:
                have.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
            ids = [have[p] for p in found]
            cut = np.cumsum([len(x) for x in ids])[[k for k, p in enumerate(found) if p == "\n"]].tolist()
            flat = b"".join(ids)
            self.known.update(zip(batch, (flat[i:j] for i, j in zip([0, *cut], cut, strict=False)), strict=True))
            for w, parts in hard.items():
                self.known[w] = b"".join([x if isinstance(x, bytes) else b"".join([have[p] for p in x]) for x in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [_split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        unknown = set().union(*split).difference(known)
        known.update([(w, before[w]) for w in unknown if w in before])
        new = unknown.difference(before)
        if new:
            self.learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]


#: Characters of words that ``learn`` splits one by one.
_HARD = re.compile("[^\0-\u024f]|<\\|")
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _split(text: str) -> list[str]:
    """Words between Unicode white space; U+001C to U+001F aren't white space here."""
    return [w for w in _WHITE.split(text) if w] if _ODD.search(text) else text.split()


@functools.lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(2)
def tokens(path: str) -> np.ndarray:
    """The token of each id."""
    spec = json.load(open(path, encoding="utf-8"))
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = np.full(max(ids.values()) + 1, "", object)
    out[list(ids.values())] = list(ids)
    return out


def _slices(batch: pa.RecordBatch, col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` characters each."""
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for i, j in zip(cut, cut[1:], strict=False):
        if i < j:
            yield batch.slice(i, j - i)


def bpe_encode(docs: DataFrame, path: str, col: str = "text", out: str = "ids", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """``keep`` and the ids of ``col``, as array<int>; no row is merged or left out.

    ``decoded`` names one more column, the text that ``bpe_decode`` makes of those ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = tokenizer(path), tokens(path) if decoded else None
        for whole in batches:
            for batch in _slices(whole, col):
                ids = bpe.encode([t or "" for t in batch.column(col).to_pylist()])
                off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
                text = [_decoded(table, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists, *text], [*keep, out, *([decoded] if decoded else [])])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"`{out}` array<int>", *([f"`{decoded}` string"] if decoded else [])])
    return docs.select(*dict.fromkeys([*keep, col])).mapInArrow(run, schema)


def _decoded(table: np.ndarray, lists: pa.ListArray) -> pa.Array:
    flat = table[lists.flatten().to_numpy(zero_copy_only=False)]
    cut = np.cumsum([0, *(x or 0 for x in lists.value_lengths().to_pylist())])
    return pa.array([" ".join(flat[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.string())


def bpe_decode(rows: DataFrame, path: str, col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids in ``col``: the file names no decoder, so its tokens joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(table, batch.column(col))], [*batch.schema.names, out])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in rows.dtypes), f"`{out}` string"])
    return rows.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_bpe_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = bpe_encode(docs, path, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
