"""Byte-pair encoding with word ends: a queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tokens import Memo, byte_letters, default_path

BATCH_BYTES = 4_000_000


class WordBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with word ends.

    Text is made NFC, white space becomes a space and letters lower case. Pre-tokens are
    contractions, runs of letters, single digits and runs of other marks; white
    space goes. A pre-token starts as byte letters, the last one with the word end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for k, m in enumerate(model["merges"]):
            self.ranks[tuple(m) if isinstance(m, list) else tuple(m.split(" "))] = k
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre = regex.compile(split["pattern"]["Regex"])
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.chunks = Memo(self._chunk, 2)
        self.words = Memo(self._word, 8)

    def merge(self, word: str) -> list[str]:
        """The symbols of one pre-token after all merges, lowest rank first and leftmost of equal ranks."""
        symbols: list[str | None] = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks.get
        queue = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := rank((symbols[k], symbols[k + 1]))) is not None]
        heapify(queue)
        while queue:
            _, k, left, right = heappop(queue)
            j = after[k]
            if symbols[k] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[k] = left = left + right
            symbols[j] = None
            after[k] = j = after[j]
            if j >= 0:
                before[j] = k
                if (r := rank((left, symbols[j]))) is not None:
                    heappush(queue, (r, k, left, symbols[j]))
            i = before[k]
            if i >= 0 and (r := rank((symbols[i], left))) is not None:
                heappush(queue, (r, i, symbols[i], left))
        return [s for s in symbols if s is not None]

    def _word(self, word: str) -> bytes:
        known = [self.vocab[s] for s in self.merge(word) if s in self.vocab]  # without an unknown token, other symbols are left out
        return np.array(known, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pre.findall(chunk)))

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each letter by itself: no final sigma

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        if not self.special_at.search(text):
            return self._plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_at.split(text))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.normalise(text).split(" "))) if text else b""

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings one after another, a space between: the file names no decoder that would join them otherwise."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_known: dict[str, WordBpe] = {}


def word_bpe(path: str | None) -> WordBpe:
    path = path or default_path("word_bpe_49k.json")
    if path not in _known:
        _known[path] = WordBpe(path)
    return _known[path]


def _whole(bpe: WordBpe, ids, texts):
    """Batches of ids and what they decode to, each of a few MB however long the texts are."""
    held, first, size = [], 0, 0
    for k, text in enumerate(texts, 1):
        held.append(bpe.encode(text))
        size += len(held[-1])
        if size >= BATCH_BYTES or k == len(texts):
            ends = np.cumsum([0, *[len(h) // 4 for h in held]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4")))
            columns = [ids.slice(first, len(held)), lists, pa.array(map(bpe.decode, held), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])
            held, first, size = [], k, 0


def _encoded(path: str | None, whole: bool):
    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if whole:
                yield from _whole(bpe, ids, texts)
                continue
            rows = []
            for text in texts:
                found = bpe.encode(text)
                rows.append((len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(bpe.decode(found).encode()).hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each row, whole texts.

    Null and empty texts have no ids and decode to the empty string. Rows are
    independent, so repeated rows, ties and other columns do not matter, and nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(path, True), "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The same work, returned as ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
