"""Suffix-array dedup of long repeats: suffixes are grouped by Lyndon prefix and sorted in linear time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of the anchors that pick candidates; every string of ``length`` bytes holds one.
ANCHOR = 72
#: Bytes of one symbol of the suffix array. Symbols are cut from a context in step with its anchor, so equal windows hold equal symbols.
BLOCK = 8
#: Contexts of a task's suffix array hold about so many bytes.
ARRAY_BYTES = 1 << 20
#: A group of one anchor with more contexts than this is resolved by hashes of its windows, spread over all tasks.
MAX_CONTEXTS = 2_000


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in order. ``symbols`` are integers above 0; a sentinel 0 is added and not returned.

    Phase 1 takes groups of suffixes in descending order, at first by first symbol. Each suffix of a group points to its
    previous smaller one: the nearest position to the left whose group is lower. The suffixes so pointed at extend their
    common prefix by the group's as many times as pointers arrive, so they leave their group for a new one just above
    it, more pointers higher. Afterwards suffixes are grouped by Lyndon prefix. Phase 2 walks the array being filled
    from the left: the suffix before each entry, and all along its pointers, take the next free place of their groups.
    Groups are walked in any order, and each position gets its pointer once, so neither phase sorts.
    """
    n = len(symbols) + 1
    text = [*symbols, 0]
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    names = {c: g for g, c in enumerate(sorted(first))}
    group = [names[c] for c in text]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = [-2] * n  # -2: its group is not done yet; -1: nothing smaller to the left
    top = len(members) - 1
    g = top
    while g >= 0:
        hits: dict[int, int] = {}
        many = False
        for i in members[g]:
            if group[i] != g or before[i] != -2:
                continue  # it has moved to a higher group, or one of its group to the right has met it
            own, j = [i], i - 1
            while True:
                while j >= 0 and before[j] != -2:
                    j = before[j]
                if j < 0 or group[j] != g:
                    break
                own.append(j)  # of the same group: it has the same smaller one to the left
                j -= 1
            for x in own:
                before[x] = j
            if j >= 0:
                many |= j in hits or len(own) > 1
                hits[j] = hits.get(j, 0) + len(own)
        if many:
            by_count: dict[int, list[int]] = {}
            for j, k in hits.items():
                by_count.setdefault(k, []).append(j)
            rounds = [by_count[k] for k in sorted(by_count, reverse=True)]
        else:
            rounds = [hits]
        for moved in rounds:
            fresh: dict[int, int] = {}
            for j in moved:
                h = group[j]
                new = fresh.get(h)
                if new is None:
                    new = fresh[h] = len(members)
                    members.append([])
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    below[up] = new
                group[j] = new
                members[new].append(j)
        g = below[g]
    # places: lowest group first
    sizes = [0] * len(members)
    for h in group:
        sizes[h] += 1
    place = [0] * len(members)
    g, at = 0, 0
    while g != -1:
        place[g] = at
        at += sizes[g]
        g = above[g]
    order = [-1] * n
    done = bytearray(n)
    order[0], done[n - 1] = n - 1, 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            h = group[j]
            order[place[h]] = j
            place[h] += 1
            done[j] = 1
            j = before[j]
    return order[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  a memory on purpose
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if len(held.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            held[name] = np.multiply.accumulate(p)
    return held["up"][:n], held["down"][:n]


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ``length``-byte window the ``k``-byte string of least hash (the leftmost of equals): its position, and the
    first and last start of the windows that pick it, which are a run.

    Equal windows pick equal anchors at equal offsets, wherever they stand.
    """
    n, w = len(data), length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    step, picks, firsts = 1 << 22, [], []
    for lo in range(0, n - length + 1, step):
        part = np.frombuffer(data, np.uint8, min(n - lo, step + length - 1), lo)
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up, out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]  # the hash of each k bytes, wherever they stand
        keys = (_mix(grams) & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        pad = -len(keys) % w
        blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - length + 1
        least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        picks.append(at[new] + lo)
        firsts.append(new + lo)
    pick, first = np.concatenate(picks), np.concatenate(firsts)
    new = np.r_[True, pick[1:] != pick[:-1]]  # a run may go on in the next part
    pick, first = pick[new], first[new]
    return pick, first, np.r_[first[1:] - 1, n - length]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching spans over the same bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def can_share(texts: list[bytes], offsets: list[int], open_: list[bool], length: int, k: int) -> list[int]:
    """Contexts of one anchor that may hold a window of another, by numbers. None that does is left out.

    A window has l bytes before the anchor and length - k - l behind it. Cut down to eighths that is one of eight pairs
    of reaches, so contexts that share a window agree on the bytes of one of these pairs.
    """
    unit = (length - k) // 8
    by: dict[tuple[int, bytes], list[int]] = {}
    for x, (text, off) in enumerate(zip(texts, offsets)):
        for i in range(8):
            left, right = off - unit * i, off + k + unit * (7 - i)
            if left >= 0 and right <= len(text):
                by.setdefault((i, text[left:right]), []).append(x)
    return sorted({x for xs in by.values() if len(xs) > 1 and any(open_[x] for x in xs) for x in xs})


def _rows_alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows that brings equal ones together, and in that order the number of each one's class."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def repeated_windows(family: np.ndarray, texts: list[bytes], offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of each window that another context of its family has at the same offset from its anchor.

    One suffix array over all contexts, in symbols of BLOCK bytes that are cut in step with the anchors, brings together
    the suffixes that agree on as many symbols as any window holds whole. Such windows differ at most in the bytes
    before the first and behind the last whole symbol; those are compared as they are.
    """
    size = np.array([len(t) for t in texts])
    core = (length - BLOCK + 1) // BLOCK
    rest = length - core * BLOCK
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(texts) < 2:
        return none
    data, base = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(size)[:-1]]
    first = offsets % BLOCK
    many = np.maximum(0, (size - first) // BLOCK)
    ctx = np.repeat(np.arange(len(texts)), many)
    no = np.arange(len(ctx)) - np.repeat(np.cumsum(many) - many, many)
    start = first[ctx] + BLOCK * no
    _, name = np.unique(np.ascontiguousarray(data[(base[ctx] + start)[:, None] + np.arange(BLOCK)]).view("<u8").ravel(), return_inverse=True)
    at = np.arange(len(ctx)) + ctx  # a separator stands behind each context
    symbols = np.ones(len(ctx) + len(texts), np.int64)
    symbols[at] = name + 2
    which = np.full(len(symbols), -1)
    which[at] = np.where(no + core <= many[ctx], np.arange(len(ctx)), -1)
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[which[order] >= 0]
    if len(order) < 2:
        return none
    views = np.lib.stride_tricks.sliding_window_view(symbols, core)
    same = np.concatenate([(views[order[a : min(a + 20_000, len(order) - 1)]] == views[order[a + 1 : a + 20_001]]).all(axis=1) for a in range(0, len(order) - 1, 20_000)])
    run = np.r_[0, np.cumsum(~same)]
    x = which[order]
    c = ctx[x]
    by, alike = _rows_alike(run, family[c], (start[x] - offsets[c]) // BLOCK)
    keep = np.bincount(alike)[alike] > 1
    x, alike = x[by][keep], alike[keep]
    # the windows whose first whole symbol stands here
    before = np.tile(np.arange(BLOCK), len(x))
    x, alike = np.repeat(x, BLOCK), np.repeat(alike, BLOCK)
    c, s = ctx[x], start[x] - before
    ok = (s >= 0) & (s + length <= size[c])
    before, alike, c, s = before[ok], alike[ok], c[ok], s[ok]
    j = np.arange(rest)
    edge = data[(base[c] + s)[:, None] + j + np.where(j >= before[:, None], core * BLOCK, 0)]
    wide = np.zeros((len(c), -(-rest // 8) * 8), np.uint8)
    wide[:, :rest] = edge
    by, equal = _rows_alike(alike, before, *wide.view("<u8").T)
    hit = by[np.bincount(equal, minlength=1)[equal] > 1] if len(by) else by
    return c[hit], s[hit]


def _spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    return merge([(s, s + length) for s in starts])


def repeated_spans(docs: DataFrame, length: int = 200, k: int = ANCHOR, max_contexts: int = MAX_CONTEXTS, text_col: str = "text") -> DataFrame:
    """(t, spans): for each text by its MD5 (binary), the byte spans covered by ``length``-byte strings that also start
    anywhere else, in another row or in the same text; merged, sorted. Texts without any are left out.

    1. Each window picks an anchor in it so that equal windows have equal anchors at equal offsets. An anchor's context is
       all bytes of windows that pick it. Only hashes of anchors and contexts are shuffled.
    2. A context that occurs twice is repeated as a whole. An anchor that occurs once has no repeat.
    3. For the contexts left, of anchors that occur in several contexts, the bytes are read again, grouped by anchor,
       and a suffix array over each batch of groups shows which windows repeat (contexts that can't share one stay out). Groups of over ``max_contexts`` are
       exact too: hashes of their windows are counted, spread over all tasks.
    """
    if not (k + 8 <= length < 1 << 15 and length >= 3 * BLOCK):
        raise ValueError("windows have from k + 8 to 32767 bytes")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    texts = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), F.col("text").cast("binary").alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h

        cols: list[list] = [[] for _ in range(6)]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, kinds)], names=["t", "a", "c", "s", "shape", "own"])
            for c in cols:
                c.clear()
            return out

        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            for t, text in zip(batch.column(0), batch.column(1)):
                t, data = t.as_py(), text.as_py()
                seen: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for p, s, last in zip(*(x.tolist() for x in anchors(data, length, k))):
                    key = (_signed(h(data[p : p + k])), _signed(h(data[s : last + length], p - s)))
                    seen.setdefault(key, []).append((s, last + length, p - s))
                for (a, c), where in seen.items():
                    own = None
                    if len(where) > 1:  # repeats within this text alone
                        own = [x for span in merge([w[:2] for w in where]) for x in span]
                    s, e, off = where[0]
                    for col, v in zip(cols, (t, a, c, s, off << 16 | e - s, own)):
                        col.append(v)
                if len(cols[0]) > 50_000:
                    yield flush()
        if cols[0]:
            yield flush()

    picked = materialise(texts.mapInArrow(pick, "t binary, a long, c long, s int, shape int, own array<int>"), "anchors")
    # equal (a, c) in one text is one row; ``own`` then counts for two
    occurs = F.when(F.col("own").isNull(), F.lit(1)).otherwise(F.lit(2))
    lead = picked.groupBy("a").agg(F.sum(occurs).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = materialise(lead.filter("n > 1").select("a", (F.col("c0") != F.col("c1")).alias("mixed")), "shared")
    live = materialise(picked.join(shared, "a"), "live")
    counts = live.filter("mixed").groupBy("a", "c").agg(F.sum(occurs).alias("n_c"), F.min(F.struct("t", "s", "shape")).alias("one"))
    counts = materialise(counts, "contexts")
    # whole contexts
    again = counts.filter("n_c > 1").select("a", "c")
    whole = live.filter("not mixed").select("t", "s", "shape", "own").unionByName(live.filter("mixed").join(again, ["a", "c"], "left_semi").select("t", "s", "shape", "own"))
    whole_spans = whole.select("t", F.when(F.col("own").isNull(), F.array(F.col("s"), F.col("s") + F.col("shape").bitwiseAND(0xFFFF))).otherwise(F.col("own")).alias("ends")).distinct()
    # contexts whose bytes must be seen: the single ones, and one of each repeated one to compare them with
    wanted = counts.select("a", "c", F.col("one.t").alias("t"), F.col("one.s").alias("s"), F.col("one.shape").alias("shape"), (F.col("n_c") == 1).alias("open"))
    by_text = materialise(wanted.groupBy("t").agg(F.collect_list(F.struct("a", "c", "s", "shape", "open")).alias("wanted")), "wanted")
    open_texts = texts.join(by_text, "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, text, asked in zip(batch.column("t"), batch.column("text"), batch.column("wanted")):
                t, data = t.as_py(), text.as_py()
                for x in asked.as_py():
                    s, shape = x["s"], x["shape"]
                    rows.append((x["a"], x["c"], x["open"], t, s, shape >> 16, data[s : s + (shape & 0xFFFF)]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), kinds)], names=["a", "c", "open", "t", "s", "off", "bytes"])

    bytes_ = open_texts.select("t", "text", "wanted").mapInArrow(cut, "a long, c long, open boolean, t binary, s int, off int, bytes binary")
    # copies of a text give a repeated context's representative more than once
    bytes_ = materialise(bytes_.dropDuplicates(["a", "c"]), "bytes")
    sizes = bytes_.groupBy("a").agg(F.count("*").alias("n"))
    crowd = materialise(sizes.filter(F.col("n") > max_contexts).select("a"), "crowd")
    grouped = bytes_.join(crowd, "a", "left_anti").repartition("a").sortWithinPartitions("a")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch | None:
            groups: dict[int, list[tuple]] = {}
            for r in rows:
                groups.setdefault(r[0], []).append(r)
            own, family = [], []
            for no, g in enumerate(groups.values()):
                if len(g) > 1 and any(r[1] for r in g):
                    live = can_share([r[5] for r in g], [r[4] for r in g], [r[1] for r in g], length, k)
                    own += [g[x] for x in live]
                    family += [no] * len(live)
            ctx, start = repeated_windows(np.array(family, np.int64), [r[5] for r in own], np.array([r[4] for r in own], np.int64), length)
            by = np.lexsort((start, ctx))
            ctx, start = ctx[by], start[by]
            starts = np.split(start, np.flatnonzero(ctx[1:] != ctx[:-1]) + 1) if len(ctx) else []
            out = []
            for r, at in zip((own[x] for x in dict.fromkeys(ctx.tolist())), starts):
                if r[1]:
                    out.append((r[2], [r[3] + x for span in _spans(at.tolist(), length) for x in span]))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], names=["t", "ends"]) if out else None

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("a", "open", "t", "s", "off", "bytes"))):
                if size >= ARRAY_BYTES and r[0] != held[-1][0]:
                    if (out := done(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(r)
                size += len(r[5]) + 1
        if held and (out := done(held)) is not None:
            yield out

    solved = grouped.select("a", "open", "t", "s", "off", "bytes").mapInArrow(solve, "t binary, ends array<int>")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as h

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for a, open_, t, s, off, data in zip(*(batch.slice(lo, 200).column(c).to_pylist() for c in ("a", "open", "t", "s", "off", "bytes"))):
                    rows += [(a, i - off, h(data[i : i + length]), t, s + i, open_) for i in range(len(data) - length + 1)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), kinds)], names=["a", "rel", "h", "t", "at", "open"])

    windows = bytes_.join(crowd, "a", "left_semi").select("a", "open", "t", "s", "off", "bytes").mapInArrow(hashes, "a long, rel int, h binary, t binary, at int, open boolean")
    many = windows.groupBy("a", "rel", "h").agg(F.count("*").alias("n")).filter("n > 1").select("a", "rel", "h")
    crowded = windows.filter("open").join(many, ["a", "rel", "h"], "left_semi").select("t", F.array(F.col("at"), F.col("at") + length).alias("ends"))
    ends = whole_spans.unionByName(solved).unionByName(crowded)
    return ends.groupBy("t").agg(F.flatten(F.collect_list("ends")).alias("ends"))


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False, **options) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if ``with_text``.

    Each byte covered by a ``length``-byte string that also starts elsewhere goes. Texts meet what was found in them by
    their MD5; nothing is broadcast, so memory and shuffle grow alike at every size, and a text of many copies is one row
    on the other side of a join whose hot partitions can be split. Null text counts as empty. Copies of
    a text of at least ``length`` bytes lose it wholly. Repeated rows count as different places; extra columns are
    ignored; an empty table gives an empty result.
    """
    spans = materialise(repeated_spans(docs, length, text_col=text_col, **options), "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("t", F.unhex(F.md5("text")))
    joined = rows.join(spans, "t", "left").select("id", "text", "ends")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ends in zip(batch.column("text"), batch.column("ends")):
                data, ends = text.as_py(), ends.as_py() or []
                n, kept, at, removed = len(data), [], 0, 0
                spans = merge([(a, min(b, n)) for a, b in zip(ends[::2], ends[1::2])])
                for a, b in spans:
                    kept.append(data[at:a])
                    at, removed = b, removed + b - a
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((n, removed, len(spans), hashlib.sha256(rest).hexdigest(), rest))
            arrays = [batch.column("id"), *(pa.array(c, ty) for c, ty in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return joined.mapInArrow(apply, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
