"""BPE with word ends: merges by a priority queue over a linked list of symbols; decoding joins vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import ucd_3_2_0

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers (about 60 MB), and characters of the longest one among them.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 64


class Merges:
    """What a tokenizer file says: vocabulary, merges, word end, how texts are normalised and split."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if odd or model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path} is another kind of tokenizer {odd}")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        # the characters that stand for bytes: printable ones for themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner, self.last = [ids[char[b]] for b in range(256)], [ids[char[b] + end] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.rank[ids[left] << 32 | ids[right]] = rank
            self.made.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {v: k for k, v in (ids | self.special).items()}
        self.parts = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")").split if self.special else lambda text: [text]
        pattern = split["pattern"]["Regex"]
        self.matches = regex.compile(pattern).findall
        self.library_matches = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.settled: dict[str, bool] = {}

    def word(self, data: bytes) -> list[int]:
        """Ids of one word.

        Symbols are nodes of a doubly linked list. The queue holds (rank, position) of each pair that can merge, lowest
        rank first, leftmost of equal ones. An entry is stale if its symbol has gone or its pair no longer makes the
        same token; such entries are passed over. A merge enters the two pairs that it touches.
        """
        n = len(data)
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [r * n + i for i in range(n - 1) if (r := self.rank.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if symbol[i] < 0 or j < 0:
                continue
            now = self.rank.get(symbol[i] << 32 | symbol[j])
            if now is None or self.made[now] != self.made[rank]:
                continue
            symbol[i], symbol[j] = self.made[rank], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (new := self.rank.get(symbol[a] << 32 | symbol[b])) is not None:
                    heapq.heappush(queue, new * n + a)
        return [s for s in symbol if s >= 0]

    def words(self, text: str) -> list[str]:
        """Words of a text between special tokens, normalised."""
        if text.isascii():  # only the case changes: white space, which alone is normalised besides, is no word
            return self.matches(text.lower())
        text = self.normalise(text)
        for c in set(text):
            if c not in self.settled:
                self.settled[c] = ucd_3_2_0.category(c) != "Cn"
            if not self.settled[c]:
                # a character younger than Unicode 3.2: the two libraries may hold it for different things
                return [word for word, _ in self.library_matches(text)]
        return self.matches(text)

    def split(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for each special token that stands in the text as it is, (None, words) for what lies between."""
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                yield self.special[part], []
            elif part:
                yield None, self.words(part)

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings one after the other with spaces between, as the library has it where a file names no decoder."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@lru_cache(1)
def merges(path: str) -> Merges:
    """One per worker process, about 30 MB."""
    return Merges(path)


class Known(dict):
    """Word -> (ids as little-endian 32-bit integers, decoded text); long words are not kept."""

    def __init__(self, bpe: Merges):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.bpe.word(word.encode())
        found = (np.array(ids, "<u4").tobytes(), self.bpe.decode(ids))
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = found
        return found


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(batches: Iterator[pa.RecordBatch], bpe: Merges, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    known = Known(bpe)
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for text in batch.column(1):
            ids, decoded = [], []
            for special, words in bpe.split(text.as_py() or ""):
                found = [known[w] for w in words] if special is None else [(np.array([special], "<u4").tobytes(), bpe.token[special])]
                ids += [a for a, _ in found]
                decoded += [b for _, b in found]
            packed = b"".join(ids)
            out[0].append(len(packed) // 4)
            out[1].append(hashlib.sha256(packed).hexdigest())
            out[2].append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
            if with_ids:
                out[3].append(np.frombuffer(packed, "<u4").astype(np.int32))
        arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, names=names)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (array of int) if ``with_ids``.

    ``path`` names a tokenizer file that every executor has. Ids are the library's without added special tokens; strings
    of special tokens that a text holds are those tokens. Null text counts as empty: no id, digests of nothing.

    Nothing is shuffled and a text never leaves its task. A task remembers the words it has encoded, up to MEMORY_WORDS
    of at most MEMORY_CHARS characters, then begins anew; that changes its speed alone. Long words take about 150 bytes a
    byte while they are encoded. Extra columns are ignored, repeated rows are encoded each, an empty table gives an empty
    result. A lost task is run again on its own rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _encode(batches, merges(path), names, with_ids), schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, text) of encoded rows, special tokens included. Null ids give null; ids that the vocabulary lacks give nothing."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if ids is None else merges(path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(texts, f"`{id_col}` {id_type}, text string")
