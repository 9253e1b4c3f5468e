"""Word BPE, source divergence and importance resampling against a library or brute force, on small odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from lattica.llm import common, divergence, resampling, word_bpe
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, terms long, n long, bucket string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def texts():
    rng = random.Random(11)
    words = [a + b for a in "ka Ro ti MU sé lo".split() for b in "bcdfgh"] + ["Straße", "don't", "x1y22", "中文", "\U0001f600", "İI"]
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 19, 20, 21, 30, 80, 200)]
    made += [made[6].replace(" ", "-\n"), made[7].upper(), made[8] + " tail", "\x1c\x85　 é Σας", "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "ab" * 3000, " ".join(rng.choice(words) for _ in range(20_000))]
    return [None, "", " \t", "12 34 !!", *made]


@pytest.fixture(scope="module")
def docs(spark):
    made = texts()
    rows = [(i, t, (None, "en", "de", "")[i % 4], None if i % 7 == 0 else f"s{i % 3}", 1, 2, "x") for i, t in enumerate(made)]
    rows += [(100 + i, made[4 + i % 9], "en", f"s{i % 5}", 0, 0, "y") for i in range(40)]
    rows += [(200, None, "xx", "only", 0, 0, ""), (201, "", "yy", "a", 0, 0, ""), (202, "one", "yy", "b", 0, 0, ""), (100, made[4], "en", "s0", 0, 0, "y")]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_word_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = word_bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    encoded = word_bpe.encode(docs, path, with_ids=True)
    want = []
    for doc, text in rows(docs.select("doc_id", "text")):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids))
    assert sorted(rows(encoded)) == sorted(want)
    decoded = {d: t for d, t in rows(word_bpe.decode(encoded, path))}
    assert all(decoded[d] == library.decode(ids, skip_special_tokens=False) for d, *_, ids in want)
    assert word_bpe.encode(docs.limit(0), path).count() == 0
    nothing = word_bpe.decode(spark.createDataFrame([(1, None), (2, [-5, 71])], "doc_id long, ids array<int>"), path)
    assert rows(nothing) == [(1, None), (2, "h")]


def test_word_bpe_random(monkeypatch):
    from tokenizers import Tokenizer

    path = word_bpe.default_vocabulary()
    library, own, rng = Tokenizer.from_file(path), word_bpe.merges(path), random.Random(2)
    monkeypatch.setattr(word_bpe, "MEMORY_WORDS", 3)  # forgets all the time
    known = word_bpe.Known(own)
    for k in range(3000):
        text = "".join(rng.choice("abcdehinorstu '1.éÉΣς́\n\x85İ中\U0001f600꟎") for _ in range(rng.randint(0, 50))) + "<|endoftext|>" * (k % 9 == 0)
        got = b"".join(struct.pack("<I", s) if s is not None else b"".join([known[w][0] for w in words]) for s, words in own.split(text))
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == b"".join(struct.pack("<I", i) for i in ids), text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert len(known) <= 3


def brute_audit(docs, min_docs, top):
    groups, df, by_doc = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        count = {s: {t: c[t] for t in kept} for (a, s), c in groups.items() if a == lang}
        count[None] = {t: sum(c[t] for c in count.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            if s is not None:
                pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o not in (None, s))
                best = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])[:top]
                out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("salted", [False, True])
def test_divergence(docs, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(divergence, "MAX_BROADCAST_GROUPS", 0)
    src = rows(docs.select("lang", "source", "text"))
    for min_docs, top in ((3, 200), (1, 3)):
        got = rows(divergence.audit(docs, min_docs, top))
        assert sorted(got) == brute_audit(src, min_docs, top)
    assert any(g[:5] == ("yy", "a", "pair", "b", 0) for g in rows(divergence.audit(docs)))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_large_counts(spark):
    part = spark.sql("select 4000000000000 as c, 5000000000000 as n, 7L as v, 12L as p, 5L as q")
    got = part.select(divergence.part(F.col("c"), F.col("n"), F.col("v")), divergence.gap(F.col("p"), F.col("q"))).first()
    assert tuple(got) == (1 + 10**9 * (4 * 10**12 + 1) // (5 * 10**12 + 7), 9)


def brute_resample(docs, target, percent, min_words):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    made = [(d, *features(text)) for d, text in docs]
    for _, _, f in made:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    alls, allt = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (alls + 10000) / ((s[b] + 1) * (allt + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("percent, min_words, steps", [(5, 20, 4096), (50, 20, 2), (100, 0, 3), (37, 1, 4096), (0, 20, 9)])
def test_resampling(spark, docs, percent, min_words, steps, monkeypatch):
    monkeypatch.setattr(resampling, "STEPS", steps)
    target = [None, "", "kab tif tig", texts()[10] + " other words here", "lob"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, id long")
    own = docs.union(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = resampling.resample(own, goal, percent, min_words)
    assert sorted(map(repr, rows(got))) == brute_resample(rows(own.select("doc_id", "text")), target, percent, min_words)


def test_resampling_edges(spark, docs):
    goal = spark.createDataFrame([("kab",)], "text string")
    assert resampling.resample(docs.limit(0), goal).count() == 0
    assert sorted(map(repr, rows(resampling.resample(docs, goal.limit(0))))) == brute_resample(rows(docs.select("doc_id", "text")), [], 5, 20)
    same = spark.createDataFrame([(7, "a b c")] * 9 + [(8, "a b c")], "doc_id long, text string")  # equal rows and ids: nine equal scores
    drawn = rows(resampling.resample(same, goal, 50, 1).filter("rank is not null").orderBy("rank"))
    assert [r[-1] for r in drawn] == [1, 2, 3, 4, 5]
