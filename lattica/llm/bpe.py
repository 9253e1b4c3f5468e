"""Byte-level BPE: each distinct word of the corpus is encoded once by merge replay, then texts are put together again."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk of texts ends when its dictionary holds so many words (about 40 MB), or at so many characters of text.
CHUNK_WORDS, CHUNK_CHARS = 1 << 18, 32 << 20
#: A chunk's words are dealt into so many buckets by a hash.
BUCKETS = 512
#: Bytes of new words that one replay takes (about 80 MB), and words of a bucket that are remembered (about 40 MB).
REPLAY_BYTES, MEMORY_WORDS = 1 << 21, 200_000


class Vocabulary:
    """Ranks of byte strings. A token's id is its rank, and the rank of the merge that makes it."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.digits = {v: str(v) for v in self.token}
        self.words = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        made = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        self.pair = np.array(sorted(made), np.int64)
        self.made = np.array([made[p] for p in self.pair.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.made[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """One word by its definition: merge the leftmost pair of lowest rank until none is left."""
        symbol = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
        rank = lambda i, j: self.rank.get(self.token[symbol[i]] + self.token[symbol[j]])
        heap = [(r, i) for i in range(len(word) - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j < 0 or rank(i, j) != r:
                continue
            symbol[i], symbol[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (i, before[i]):
                if a >= 0 and after[a] >= 0 and (new := rank(a, after[a])) is not None:
                    heapq.heappush(heap, (new, a))
        return [s for s in symbol if s >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has.

        All words stand in one array of symbols. An inverted index leads from each merge to the positions where it may
        apply. Merges are taken in rank order, each at all its positions at once, which changes only the neighbours'
        entries; an entry that no longer holds its pair is passed over. Of positions that overlap the first, third, ...
        of a run merge, as from the left.

        Ranks are by bytes, not by a merge list, so a merge can make a pair of its own or a lower rank. It then is the
        word's next merge: with one merge of this rank in the word, the heap brings it up next. With several the others
        came too early, and the word is encoded by itself.
        """
        size = np.array([len(w) for w in words], np.int64)
        symbol = self.byte.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after, before = np.arange(1, len(symbol) + 1, dtype=np.int32), np.arange(-1, len(symbol) - 1, dtype=np.int32)
        after[ends[size > 0] - 1] = -1
        before[(ends - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(rank: np.ndarray, at: np.ndarray) -> None:
            some = rank >= 0
            rank, at = rank[some], at[some]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[a:b])

        start = np.flatnonzero(after >= 0)
        enter(self.merged(symbol[start], symbol[start + 1]), start)
        odd: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            i = np.concatenate(index.pop(rank))
            i = i[(symbol[i] >= 0) & (after[i] >= 0)]
            if len(i) > 1:
                i.sort()
                i = i[np.r_[True, i[1:] != i[:-1]]]
            i = i[self.merged(symbol[i], symbol[after[i]]) == rank]
            if not len(i):
                continue
            touching = i[1:] == after[i[:-1]]
            if touching.any():
                k = np.arange(len(i))
                i = i[(k - np.maximum.accumulate(np.where(np.r_[True, ~touching], k, 0))) % 2 == 0]
            j = after[i]
            beyond = after[j]
            symbol[i], symbol[j], after[i] = rank, -1, beyond
            more = beyond >= 0
            before[beyond[more]] = i[more]
            ahead = before[i]
            start = np.concatenate([i[more], ahead[ahead >= 0]])
            new = self.merged(symbol[start], symbol[after[start]])
            early = (new >= 0) & (new <= rank)
            if early.any():
                own = word[i]
                odd.update(np.intersect1d(own[1:][own[1:] == own[:-1]], word[start[early]]).tolist())
            enter(new, start)
        left = symbol >= 0
        ids, counts = symbol[left], np.bincount(word[left], minlength=len(words))
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w in odd:
                parts[w] = np.array(self.alone(words[w]), np.int64)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(1)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process, about 20 MB; nothing of the texts stays in it."""
    return Vocabulary(path, pattern)


class Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def pack(numbers: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next ones, as far as they go: like stands by like, which compresses."""
    top, shift, planes = int(numbers.max(initial=0)), 0, []
    while not planes or top >> shift:
        planes.append((numbers >> shift).astype(np.uint8).tobytes())
        shift += 8
    return compress(b"".join(planes), 1)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(decompress(packed), np.uint8).reshape(-1, n) if n else ()
    return sum((p.astype(np.int64) << 8 * k for k, p in enumerate(planes)), np.zeros(n, np.int64))


#: Columns of what the split gives: texts have id, n and numbers; a bucket of a dictionary has bucket, n, numbers (its words' lengths) and words.
CODED = ["chunk", "bucket", "id", "n", "numbers", "words"]


def _split(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (id, text): a row for each text, in the numbers of its chunk's dictionary, and one for each bucket of the
    dictionary. Its words are numbered bucket by bucket."""
    first, chunk = TaskContext.get().partitionId() << 32, 0
    numbers, chars = Numbers(), 0
    ids: list[pa.Array] = []
    texts: list[np.ndarray] = []

    def rows(count: int, **columns) -> pa.RecordBatch:
        kinds = dict(zip(CODED, [pa.int64(), pa.int32(), id_type, pa.int32(), pa.binary(), pa.binary()]))
        columns["chunk"] = [first + chunk] * count
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in kinds.items()], names=CODED)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal numbers, chars, chunk
        words = [w.encode() for w in numbers]
        bucket = np.array([crc32(w) for w in words], np.uint32) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if len(order):
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            parts = [[words[k] for k in order[a:b].tolist()] for a, b in zip(cuts, cuts[1:])]
            yield rows(
                len(parts), bucket=bucket[order[cuts[:-1]]].astype(np.int32), n=[len(p) for p in parts],
                numbers=[pack(np.array([len(w) for w in p])) for p in parts], words=[compress(b"".join(p), 1) for p in parts])
        at = 0
        for part in ids:
            for lo in range(0, len(part), 500):
                own = texts[at : at + min(500, len(part) - lo)]
                at += len(own)
                yield rows(len(own), id=part.slice(lo, len(own)), n=[len(x) for x in own], numbers=[pack(place[x]) for x in own])
        ids.clear()
        texts.clear()
        numbers, chars, chunk = Numbers(), 0, chunk + 1

    for batch in batches:
        done = 0
        for k, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            texts.append(np.array(list(map(numbers.__getitem__, vocab.words(text))), np.int32))
            chars += len(text)
            if len(numbers) >= CHUNK_WORDS or chars >= CHUNK_CHARS:
                ids.append(batch.column(0).slice(done, k + 1 - done))
                done = k + 1
                yield from close()
        ids.append(batch.column(0).slice(done))
    yield from close()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dictionaries' rows alone. A filter would move below the shuffle that this reads, which then were another one."""
    for batch in batches:
        yield batch.filter(batch["bucket"].is_valid()).select(["chunk", "bucket", "n", "numbers", "words"])


def _learn(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, n, numbers, words) sorted by bucket: (chunk, bucket, n, counts, ids). A word of a bucket is
    encoded when it first comes up, together with other new ones."""
    known, words, last, size = Numbers(), [], None, 0
    flat, many = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids of the known words, and how many each has
    held: list[tuple[int, int, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal flat, many, size
        ids, counts = vocab.replay(words)
        flat, many = np.concatenate([flat, ids]), np.concatenate([many, counts])
        words.clear()
        starts = np.cumsum(many) - many
        out: tuple[list, ...] = ([], [], [], [], [])
        for chunk, bucket, own in held:
            n = many[own]
            at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for col, x in zip(out, (chunk, bucket, len(own), pack(n), pack(flat[at]))):
                col.append(x)
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["chunk", "bucket", "n", "counts", "ids"])

    for batch in batches:
        for chunk, bucket, n, lengths, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and len(known) > MEMORY_WORDS // 4 or len(known) > MEMORY_WORDS:
                if held:
                    yield flush()
                known, flat, many = Numbers(), flat[:0], many[:0]
            blob, ends = decompress(blob), np.cumsum(unpack(lengths, n)).tolist()
            own = [blob[a:b] for a, b in zip([0, *ends], ends)]
            last, before = bucket, len(known)
            held.append((chunk, bucket, np.array(list(map(known.__getitem__, own)), np.int64)))
            if len(known) > before:  # new words are the last of the dictionary
                fresh = [w for w in own if known[w] >= before]
                words += fresh
                size += sum(map(len, fresh))
            if size >= REPLAY_BYTES or len(held) >= 4096:
                yield flush()
    if held:
        yield flush()


def join(learned: pa.Table, texts: pa.Table, vocab: Vocabulary, names: list[str], with_ids: bool) -> pa.Table:
    """A chunk's dictionary (bucket, n, counts, ids) and its texts (id, n, numbers; rows with a bucket are none): a row for each text."""
    texts = texts.filter(texts["bucket"].is_null())
    many, flat = [np.zeros(0, np.int64)], []
    learned = learned.sort_by("bucket")
    for n, counts, ids in zip(*(learned[c].to_pylist() for c in ("n", "counts", "ids"))):
        many.append(unpack(counts, n))
        flat.append(unpack(ids, int(many[-1].sum())))
    many = np.concatenate(many)
    flat = np.concatenate(flat).tolist() if flat else []
    ends = np.cumsum(many).tolist()
    token, digits = vocab.token, vocab.digits
    starts = [0, *ends]
    decimal = [",".join([digits[x] for x in flat[a:b]]) for a, b in zip(starts, ends)]
    plain = [b"".join([token[x] for x in flat[a:b]]) for a, b in zip(starts, ends)]
    out: tuple[list, ...] = ([], [], [], [])
    for n, packed in zip(texts["n"].to_pylist(), texts["numbers"].to_pylist()):
        own = unpack(packed, n)
        listed = own.tolist()
        out[0].append(int(many[own].sum()) if n else 0)
        out[1].append(hashlib.sha256(",".join([decimal[x] for x in listed]).encode()).hexdigest())
        out[2].append(hashlib.sha256(b"".join([plain[x] for x in listed])).hexdigest())
        if with_ids:
            out[3].append([i for x in listed for i in flat[starts[x] : ends[x]]])
    arrays = [texts["id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
    return pa.table(arrays + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, names=names)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (array of int) if ``with_ids``.

    ``path`` names a file of ranks that every executor has. Ids are those of the plain rank-by-rank encoding of each
    match of ``pattern``, no special tokens; they are then decoded to bytes again. Null text counts as empty: no id.

    1. Texts are split into words, once. A task cuts its texts into chunks; a text becomes numbers of its chunk's
       dictionary, two bytes a word about. Both are dealt out by chunk.
    2. The dictionaries' words are dealt out again by bucket, so each distinct word of the corpus comes to one task,
       which replays the merges over all its words. A frequent word is there once a chunk, not once an occurrence. A task
       streams a bucket's rows and remembers MEMORY_WORDS of them; a word beyond that is encoded again.
    3. Dictionaries go back to their chunks, which are of bounded size, and texts are put together.

    Texts themselves are never shuffled; their numbers are, once. Extra columns are ignored, repeated rows are encoded
    each, an empty table gives an empty result.

    ``docs`` must be a table at rest (files), whose partitions hold the same rows in the same order when a task runs
    again: chunks are numbered by them, and after the loss of an executor one made anew has to be the one that was lost.
    Write the result of a shuffle first, as the pipeline does after each of its stages.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _split(chain([first], batches), vocabulary(path, pattern), first.schema.field(0).type)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInArrow(split, f"chunk long, bucket int, id {id_type}, n int, numbers binary, words binary").repartition("chunk")
    # both readers take all columns and rows, and so the same shuffle
    words = coded.mapInArrow(_words, "chunk long, bucket int, n int, numbers binary, words binary")
    learned = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _learn(batches, vocabulary(path, pattern)), "chunk long, bucket int, n int, counts binary, ids binary")
    return learned.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(lambda a, b: join(a, b, vocabulary(path, pattern), names, with_ids), schema)
