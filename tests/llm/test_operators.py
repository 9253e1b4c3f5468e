"""The ten operators against brute force, on small fixtures with nulls, ties, copies, long and empty texts."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from lattica.llm import bpe, common, embeddings, exact_dedup, licenses, mixing, pii, simhash, suffixes, toxicity, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, keep_id long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def texts():
    rng = random.Random(5)
    words = [w + v for w in "ka ro ti mu se lo ny pe du xi".split() for v in "bcdfghjklm"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 30, 90, 200, 400)]
    out = [None, "", " \t\n", *base, base[5], base[5].replace(" ", "\u000b\n"), base[5] + "  ", base[6][:700] + "zzz" + base[6][704:], base[7] + " " + base[6],
           "É" * 300, "ab" * 400, "The Fo o BAR   baz", "\U0001f600 smile " * 40, " ".join(rng.choice(words) for _ in range(20_000))]
    near = base[7].split()
    near[10] = "changed"
    return [*out, " ".join(near), base[4].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i % 7 == 0 else f"s{i % 4}", None, 1, 2) for i, t in enumerate(texts())]
    rows += [(3, texts()[3], "x", "s1", 0, 0, 0), (None, texts()[8], None, "s2", None, 0, 0), (None, "alone here", None, "s2", None, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(spark, docs):
    src = rows(docs.select("doc_id", "text"))
    for options in ({}, {"max_broadcast_keys": 0}, {"digest_all": True}, {"digest_all": True, "max_broadcast_keys": 0}, {"prefix_chars": 1}):
        got = exact_dedup.exact_dedup(docs, **options).collect()
        assert len(got) == len(src)
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups = {}
        for i, t in src:
            groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
        want = sorted((repr(i), repr(min(groups[norm(t)])[2]), len(groups[norm(t)]), norm(t)) for i, t in src)
        assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"]) for r in got) == sorted(w[:3] for w in want)
        if "digest_all" in options:
            assert sorted(r["content_hash"] for r in got) == sorted(hashlib.sha256(w[3].encode()).hexdigest() for w in want)
    for options in ({}, {"max_broadcast_keys": 0, "max_broadcast_rows": 0}):
        kept = exact_dedup.keep_one(docs, **options)
        assert kept.columns == docs.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)
    clash = docs.withColumnsRenamed({"fp": "_own_hash", "lang": "_hash", "n_chars": "norm_bytes"}).withColumn("_own_points", F.lit("a"))
    kept = exact_dedup.keep_one(clash).collect()
    assert len(kept) == len(groups) and {r["_own_points"] for r in kept} == {"a"} and {r["_own_hash"] for r in kept} <= {0, 1}
    full = exact_dedup.exact_dedup(docs).filter("group_size = 1 and content_hash is not null").count()
    assert full < len(src) / 4  # unique texts of a length or prefix of their own are never read in full
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t in rows(docs.select("doc_id", "text")))
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    weight = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [3, 1, 2] * len(by)))
    target = {s: 0.0 for s in by}
    full = {s: 2.0 * by[s][0]["source_size"] for s in by}
    open_, rest = set(by), 1.5 * total
    while open_:  # reshare the excess until no source is above its cap
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= full[s]}
        for s in over or open_:
            target[s] = full[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rs)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs, rows_per_bucket=2).collect()))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    copies = mixing.mix(docs, whole_documents=True).agg(F.sum("copies")).first()[0]
    assert out.count() == copies
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_inversion(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.5))
    xs = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(mixing.position(F.col("x"), schedule)).collect()]
    t, w, _ = mixing.cumulative(schedule)
    grid = np.linspace(0, 1, 200_001)
    demand = np.concatenate([[0], np.cumsum((np.interp(grid, t, w)[1:] + np.interp(grid, t, w)[:-1]) / 2 * np.diff(grid))])
    assert np.allclose(np.interp(got, grid, demand) / demand[-1], xs, atol=1e-6)


def test_mix_holds_at_all_times(spark):
    made = [(i, "w " * 10, f"s{i % 6}") for i in range(1800)] + [(None, "w " * 10, "s0")] * 30
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    flat = {f"s{k}": ((0, 1), (1, 1)) for k in range(6)}
    weights = {f"s{k}": w for k, w in enumerate([3, 1, 2, 3, 1, 2])}
    order = [r["source"] for r in mixing.apply_mix(df, weights=weights, schedules=flat).collect()]
    want = {s: order.count(s) / len(order) for s in flat}
    for q in range(4):
        part = order[len(order) * q // 4 : len(order) * (q + 1) // 4]
        assert all(part.count(s) / len(part) == pytest.approx(want[s], abs=0.02) for s in flat)
    seen = [i for i, r in enumerate(mixing.apply_mix(df, weights=weights, schedules=flat).collect()) if r["doc_id"] == 3]
    assert len(seen) == 2 and seen[1] - seen[0] == pytest.approx(len(order) / 2, rel=0.05)
    mixed = mixing.mix(df, whole_documents=True).collect()
    assert all(len(r["positions"]) == r["copies"] and r["positions"] == sorted(r["positions"]) for r in mixed)
    early = {s: np.mean([x < 0.5 for r in mixed if r["source"] == s for x in r["positions"]]) for s in flat}
    assert early["s0"] > 0.6 and early["s1"] < 0.4 and early["s2"] == pytest.approx(0.5, abs=0.03)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 300_000
    pages = [(i, f"http://h/{i}", h, "junk") for i, h in enumerate(["<a>" * 50, big, None, "", "short", "short", "<a>" * 50, big, "\r\n\r\nWARC/1.1\r\n" * 20, "<a>" * 50])]
    pages += [(6, "u", "<a>" * 50, "again"), (None, None, big, None)] + [(100 + i, "u", f"<html>{'lorem ipsum ' * (i % 60)}{i}</html>", "") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write(df, path)
    got = {}
    for r in warc.read(spark, path).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(pages)
    first = {}
    for i, _, h, _ in pages:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    for i, url, h, _ in pages:
        body = (h or "").encode()
        r = got[i][0]
        kind = "response" if first.get(h, i) == i else "revisit"
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), kind, first[h] if kind == "revisit" else None)
        if kind == "response":
            assert bytes(r["payload"]) == body
    blobs = [bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert all(b[:4] == warc.DICT_MAGIC for b in blobs)
    warc.write(df.limit(0), path + "0")
    assert warc.read(spark, path + "0").count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-3]}1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]]
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.93
    auc = np.mean([a > b for a in held[held.toxic == 1].score for b in held[held.toxic == 0].score])
    assert auc > 0.9
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "a"), (1, "You are a stupid idiot, you m0r0n!!", "a")], "doc_id long, text string, score string")
    out = toxicity.score_documents(odd, labels.limit(0))
    assert out.count() == 3
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0


def test_isotonic_and_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.fit_trees(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.97
    at, value = toxicity.isotonic(trees.margin(x), y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all()


def test_pii():
    key = b"key"
    text = "Mary Smith, +1 (974) 555-3436 or +1 974 555 3436; a.b7@mail7.example.com A.B7@MAIL7.example.com 97.51.17.173 4539148803436467 123-45-6789"
    out, found = pii.replace(key, text)
    assert len(out) == len(out) and not any(e.text in out for e in found if e.kind != "given latin female")
    again = {e.kind: [x for x in pii.find(out) if x.kind == e.kind] for e in found}
    assert all(again[k] for k in again)
    by = {}
    for e in found:
        by.setdefault((e.kind, pii.canonical(e.kind, e.text)), set()).add(pii.canonical(e.kind, pii.surrogate(key, e.kind, e.text)))
    assert all(len(v) == 1 for v in by.values())
    card = pii.surrogate(key, "card", "4539148803436467")
    assert pii._luhn([int(c) for c in card[:-1]]) == int(card[-1])
    for kind, make in (("ssn", lambda i: f"{i:03d}-45-6789"), ("secret", lambda i: f"{i:032x}"), ("email", lambda i: f"x{i:04d}@a.example"), ("phone", lambda i: f"+1 974 555 {i:04d}"), ("ip", lambda i: f"10.0.{i // 250}.{i % 250}")):
        made = {pii.surrogate(key, kind, make(i)) for i in range(1000)}
        assert len(made) == 1000
    for group, names in pii.GIVEN.items():
        made = [pii.surrogate(key, f"given {group}", n) for n in names]
        assert sorted(made) == sorted(names) and all(a != b for a, b in zip(made, names))
    assert pii.replace(key, "") == ("", []) and pii.replace(key, "nothing here")[0] == "nothing here"


def test_pii_documents(spark, docs):
    extra = spark.createDataFrame([(900, "mail x.y@z.example", None, None, None, 1, 1), (901, "again x.y@z.example and 10.1.2.3", None, None, None, 1, 1)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs.unionByName(extra), "k").collect()}
    assert got[0]["text"] is None and got[0]["n_entities"] == 0
    assert got[900]["text"].split()[1] == got[901]["text"].split()[1] != "x.y@z.example"
    assert got[901]["kinds"] == "email,ip"
    assert pii.collisions(spark.createDataFrame([("a", "x", "1"), ("a", "x", "2"), ("b", "x", "1")], "kind string, surrogate string, original string")).count() == 1
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


NAMES = {
    "I met Olga Petrova and Ahmed Khan yesterday.": "Olga Petrova Ahmed Khan", "Ask MARY SMITH, not Bob.": "MARY SMITH", "Yesterday Prof Smith spoke. Smith left.": "Smith Smith",
    "Jean jackets, Claire de lune and Rosa parks are things.": "", "Wei Zhang wrote it.": "Wei Zhang", "my name is Kwame Osei, call me Kwame": "Kwame Osei Kwame",
    "Dear Anna, thank you.": "Anna", "Frau Dr. Sabine Müller und Herr Weber": "Sabine Müller Weber", "The River Station In The North opened.": "", "Contact Ngozi Adeyemi at the desk.": "Ngozi Adeyemi",
    "Der Hund und die Katze spielen im Garten.": "", "Иван Петров пришёл, Петров ушёл": "Иван Петров Петров", "Mrs. Baker and John Paul Jones": "Baker John Paul Jones",
    "Dear Sir, nothing here": "", "Thomas said so": "", "Monsieur Dupont, bonjour": "Dupont"}


def test_pii_names():
    """Precision and recall of names, word by word."""
    hit = found = wanted = 0
    for text, names in NAMES.items():
        got = [e.text for e in pii.find(text)]
        want = names.split()
        hit += sum(min(got.count(w), want.count(w)) for w in set(want))
        found, wanted = found + len(got), wanted + len(want)
    assert hit / wanted >= 0.95 and hit / found >= 0.95
    out, _ = pii.replace(b"k", "Mary Smith met MARY SMITH. Mary left.")
    a, b, c, d = (out.split()[k].strip(".") for k in (0, 1, 3, 4))
    assert c == a.upper() and d == b.upper() and out.split()[5] == a and a != "Mary" and b != "Smith"


def test_pii_over_a_table(spark):
    """Coreference and distinctness of everything found in a table, by brute force."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    by, back, n = {}, {}, {}
    for i, t in rows(df.select("doc_id", "text")):
        for e in pii.find(t or ""):
            own = e.kind, pii.canonical(e.kind, e.text)
            new = e.kind, pii.canonical(e.kind, pii.surrogate(b"k", e.kind, e.text))
            assert by.setdefault(own, new) == new and back.setdefault(new, own) == own
            n[i] = n.get(i, 0) + 1
    assert len(by) > 10
    got = pii.pseudonymise(df, "k").collect()
    src = dict(rows(df.select("doc_id", "text")))
    assert {r["doc_id"]: r["n_entities"] for r in got if r["n_entities"]} == n
    assert all(r["text"] == pii.replace(b"k", src[r["doc_id"]])[0] for r in got)


def test_pii_one_to_one(spark):
    one = lambda kind, text: pii.canonical(kind, pii.surrogate(b"k", kind, text))
    for forms in (["+19745553436", "+1 974 555 3436", "+1 (974) 555-3436"], ["+491701234567", "+49 170 1234567"], ["+35312345678", "+353 1 234 5678"]):
        assert len({pii.canonical("phone", f) for f in forms}) == len({one("phone", f) for f in forms}) == 1
    assert one("phone", "+49 170 1234567").startswith("+49") and one("phone", "+353 1 234 5678").startswith("+353")
    ibans = [f"DE{c:02d}370400440532013000" for c in range(100)]
    assert len({one("iban", i) for i in ibans}) == 100
    new = one("iban", "DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert one("ip", "10.01.2.3") == one("ip", "10.1.2.3") and pii.canonical("ip", "10.01.2.3") == "10.1.2.3"
    # two kinds of secret with one surrogate: a hex one, and one whose letters and digits map onto the same string
    made = {}
    for i in range(60_000):
        made[pii.surrogate(b"k", "secret", f"{i:08x}")] = f"{i:08x}"
    hit = next((o for t in made if (o := unlike(b"k", "secret", t)) and not re.fullmatch("[0-9a-f]+", o)), None)
    other = made[pii.surrogate(b"k", "secret", hit)]
    df = spark.createDataFrame([(1, f"token={hit}"), (2, f"token={other}"), (3, f"token={hit} token={other}")], "doc_id long, text string")
    assert pii.collisions(pii.entities(df, "k")).count() == 1
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k").collect()}
    assert got[1] != got[2] and got[3] == f"{got[1]} {got[2]}"


def unlike(key, tweak, text):
    """The inverse of pii.like for lower-case text of digits and a-z."""
    found = [pii._CLASS[c] for c in text]
    shape = "".join(chr(97 + k) for k, _ in found)
    sizes = [len(pii.CLASSES[k]) for k, _ in found]
    half, name = len(text) // 2, ",".join(map(str, sizes))

    def pack(part):
        v = 0
        for (_, i), n in part:
            v = v * n + i
        return v

    cells = list(zip(found, sizes))
    a, b, na, nb = pack(cells[:half]), pack(cells[half:]), int(np.prod(sizes[:half])), int(np.prod(sizes[half:]))
    for r in reversed(range(4)):
        b = (b - pii._number(key, f"{tweak}/{shape}", name, r, "b", a)) % nb
        a = (a - pii._number(key, f"{tweak}/{shape}", name, r, "a", b)) % na
    out = []
    for v, ns in ((b, sizes[half:]), (a, sizes[:half])):
        for n in reversed(ns):
            v, x = divmod(v, n)
            out.append(x)
    back = "".join(pii.CLASSES[k][x] for (k, _), x in zip(found, out[::-1]))
    assert pii.like(key, tweak, back) == text
    return back


def brute_simhash(src, n, budget):
    from xxhash import xxh64

    fps = []
    for _, t in src:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
        hs = [xxh64(s, seed=42).intdigest() for s in shingles]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    return fps, components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget], len(fps))


def components(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs):
    src = rows(docs.select("doc_id", "text"))
    fps, root = brute_simhash(src, 3, 3)
    low = {}
    for (i, _), r in zip(src, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(repr((i, fp, low.get(r))) for (i, _), fp, r in zip(src, fps, root))
    got = simhash.near_dups(docs)
    assert sorted(repr((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in got.collect()) == want
    assert simhash.near_dups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("budget", "agree"), [(3, 1), (3, 2), (7, 2), (9, 2)])
def test_trie_join(spark, budget, agree):
    rng = random.Random(budget)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, budget + 1)))
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r["node"] % 2**64: r["component"] for r in common.connected_components(simhash.link_fingerprints(df, budget, agree)).collect()}
    root = components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget], len(fps))
    for i in range(len(fps)):
        for j in range(i):
            same = fps[i] in got and got.get(fps[i]) == got.get(fps[j])
            assert same == (root[i] == root[j])


def test_near_copies(spark, docs):
    src = sorted({(repr(i), t or "") for i, t in rows(docs.select("doc_id", "text"))})
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in src]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in range(len(src)) for j in range(i) if like(sets[i], sets[j])]
    root = components(pairs, len(src))
    for df in (docs, docs.withColumnsRenamed({"fp": "_k_id", "lang": "_h", "keep_id": "h"})):
        kept = simhash.drop_near_copies(df)
        assert kept.columns == df.columns
        assert len({(repr(i), t or "") for i, t in rows(kept.select("doc_id", "text"))}) == len(set(root))
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_prefix_keys():
    """Similar sets have a common key, whatever the rarity of tokens is."""
    rng = np.random.default_rng(7)
    tried = 0
    for n in [*range(1, 60), *range(60, 3000, 97)] * 3:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            keep = a[rng.permutation(len(a))[: len(a) - rng.integers(0, len(a) // 5 + 1)]]
            b = np.union1d(keep, rng.integers(0, 2**63, rng.integers(0, n // 4 + 1), dtype=np.uint64))
            if len(keep) < 0.8 * len(np.union1d(a, b)):
                continue
            tried += 1
            size = np.array([len(a), len(b)])
            prefix, rarest = simhash.prefix_lengths(size, 0.8)
            assert (prefix <= size).all() and (rarest >= 1).all()
            tokens = [x[:k] for x, k in zip((a, b), prefix)]
            both = np.intersect1d(*tokens)
            # the worst order: tokens of one set alone are all rarer than the common ones
            order = {t: (t in set(both.tolist()), rng.random()) for t in np.union1d(*tokens).tolist()}
            keys = [sorted(x.tolist(), key=order.get)[:k] for x, k in zip(tokens, rarest)]
            assert not set(keys[0]).isdisjoint(keys[1])
    assert tried > 300


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_near_copies_of_any_fingerprint(spark, monkeypatch, chunk):
    """All pairs of Jaccard 0.8 are found, however their fingerprints differ."""
    rng = random.Random(11)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    made = []
    for n in [3, 5, 8, 9, 12, 14, 20, 30, 50, 80, 150, 300] * 4:
        base = line(n)
        swapped = list(base)
        swapped[rng.randrange(n)] = "other"
        made += [base, base + line(n * 22 // 100), base[: n - n // 10] + line(n // 10), swapped, base + base[: n // 2], line(n)]
    src = [(i, " ".join(w)) for i, w in enumerate(made)] + [(1000, ""), (1001, None), (1002, "  ")]
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in src]
    fps = [simhash.fingerprint(t, 3) for _, t in src]
    pairs = [(i, j) for i in range(len(src)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum((fps[i] ^ fps[j]).bit_count() > 9 for i, j in pairs) > 20
    df = spark.createDataFrame(src, "doc_id long, text string")
    root = components(pairs, len(src))
    if chunk > 500:
        kept = simhash.drop_near_copies(df)
        assert {r["doc_id"] for r in kept.collect()} == {src[i][0] for i, r in enumerate(root) if r == i}
        return
    # candidates alone, with small chunks, in this process
    monkeypatch.setattr(simhash, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(simhash.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_pylist([{"id": i, "h": str(i), "text": t or ""} for i, t in src], pa.schema([("id", pa.int64()), ("h", pa.string()), ("text", pa.string())]))
    made = pa.Table.from_batches(simhash._cut(iter([batch]), pa.int64(), 0.8, 5, 3, 256)).to_pylist()
    texts = [r for r in made if r["fps"] is not None]
    assert len(texts) > 3
    kinds = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("start", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
    asked = sorted(({k: r[k] for k in kinds.names} for r in made if r["bucket"] is not None), key=lambda r: r["bucket"])
    counted = pa.Table.from_batches(simhash._count(iter([pa.RecordBatch.from_pylist(asked, kinds)]))).to_pylist()
    kinds = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("fps", "sizes", "at", "tokens", "counts"))])
    both = [{k: r.get(k) for k in kinds.names} for r in texts + counted]
    both.sort(key=lambda r: r["chunk"])
    keys = pa.Table.from_batches(simhash._keys(iter([pa.RecordBatch.from_pylist(both[k : k + 5], kinds) for k in range(0, len(both), 5)]), 0.8)).to_pylist()
    first, links = {}, []
    for r in keys:
        links.append((r["a"], r["b"] if r["key"] is None else first.setdefault(r["key"], r["a"])))
    own = {np.uint64(f).view(np.int64).item(): k for k, f in enumerate(fps)}
    root = components([(own[a], own[b]) for a, b in links], len(src))
    assert all(root[own[np.uint64(fps[i]).view(np.int64).item()]] == root[own[np.uint64(fps[j]).view(np.int64).item()]] for i, j in pairs)


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(src, length):
    seen = {}
    for _, t in src:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for doc_id, t in src:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield doc_id, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("max_contexts", [2000, 2])
def test_repeats(spark, docs, max_contexts):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(40) for _ in range(4)]
    more = [(50 + i, line(rng.randint(0, 60)) + rng.choice(["", "é"]) + shared[i % 4][rng.randint(0, 30) : rng.randint(180, 260)] + line(20), None, None, None, 0, 0) for i in range(60)]
    df = docs.filter("doc_id is null or doc_id <> 24").unionByName(spark.createDataFrame(more, SCHEMA))
    src = rows(df.select("doc_id", "text"))
    got = rows(suffixes.remove_repeats(df, max_contexts=max_contexts))
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(src, 200)))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def tokenizer():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_words():
    vocab, enc = bpe.Vocabulary(*bpe.default_vocabulary()), tokenizer()
    rng = random.Random(8)
    words = ["a" * 50, "", " ", "aaaa bbbb", "<|endoftext|>"] + ["".join(rng.choice("etaoinshrdlu éЖ中\U0001f600") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    single = [w.encode() for w in words if len(vocab.words(w)) <= 1] + [b"a" * 5000, b" " * 3001, b"ab" * 700]
    single += [bytes(rng.choice(b"aab ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    want = [enc._core_bpe.encode_single_piece(w) if w else [] for w in single]
    ids, counts = vocab.replay(single)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [vocab.alone(w) for w in single] == want


def by_id(found):
    return sorted(map(repr, found))


@pytest.mark.parametrize("words, size", [(1 << 16, 1 << 20), (20, 200)])
def test_bpe_documents(spark, docs, monkeypatch, words, size):
    enc = tokenizer()
    vocab = bpe.Vocabulary(*bpe.default_vocabulary())
    monkeypatch.setattr(bpe, "REPLAY_BYTES", size)
    got = bpe.encode(docs, *bpe.default_vocabulary(), with_ids=True)
    src = rows(docs.select("doc_id", "text"))
    ids = [enc.encode_ordinary(t or "") for _, t in src]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode()), x) for (i, t), x in zip(src, ids)]
    assert by_id(rows(got)) == by_id(want)
    assert bpe.encode(docs.limit(0), *bpe.default_vocabulary()).count() == 0
    # the same in this process, where chunks can be made small
    monkeypatch.setattr(bpe, "CHUNK_WORDS", words)
    monkeypatch.setattr(bpe.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in src], pa.int64()), pa.array([t for _, t in src], pa.string())], names=["id", "text"])
    made = pa.Table.from_batches(bpe._split(iter([batch]), vocab, pa.int64()))
    dictionary = made.filter(pc.is_valid(made["bucket"])).sort_by("bucket").select(["chunk", "bucket", "n", "numbers", "words"])
    assert (len(set(dictionary["chunk"].to_pylist())) > 3) == (words == 20)
    learned = pa.Table.from_batches(bpe._learn(iter(dictionary.to_batches(max_chunksize=7)), vocab))
    texts_ = made.filter(pc.is_null(made["bucket"]))
    names, out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"], []
    for chunk in sorted(set(texts_["chunk"].to_pylist())):
        out += bpe.join(learned.filter(pc.equal(learned["chunk"], chunk)), texts_.filter(pc.equal(texts_["chunk"], chunk)), vocab, names, True).to_pylist()
    assert by_id(tuple(r.values()) for r in out) == by_id(want)


@pytest.mark.parametrize("top", [0, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24])
def test_packing(top):
    numbers = np.array([top, 0, top // 2, 7])
    assert (bpe.unpack(bpe.pack(numbers), 4) == numbers).all() and not len(bpe.unpack(bpe.pack(numbers[:0]), 0))


def licence_passages(text, threshold=0.8):
    """Every template against every passage of its sizes, without any pruning."""
    words = licenses.python_words(text or "")
    grams, found = licenses.python_bigrams(words), []
    for name, own in sorted((name, licenses.python_words(t)) for name, ts in licenses.TEMPLATES.items() for t in ts):
        want, best = set(licenses.python_bigrams(own)), None
        for size in sorted({len(own) - 1, round(0.8 * (len(own) - 1)), round(1.25 * (len(own) - 1))}):
            for start in range(len(grams)):
                have = set(grams[start : start + size])
                dice = 2 * len(have & want) / (len(have) + len(want))
                end = min(start + size + 1, len(words))
                telling = licenses.guard(own)
                if licenses.deniable(own) and licenses.DENIALS.intersection(grams[max(0, start - 2) : start + size]) or not set(licenses.required(own)) <= set(words[start:end]):
                    continue
                if dice >= threshold and (telling is None or sorted(licenses.TELLING.intersection(words[start:end])) == telling):
                    best = min(best or (0,), (-dice, name, start, end))
        found += [best] if best else []
    kept = []
    for h in sorted(found):
        if all(h[2] >= k[3] or h[3] <= k[2] for k in kept):
            kept.append(h)
    return [(name, -d, start, end - start) for d, name, start, end in kept]


def test_licenses(spark, docs):
    mit, bsd = licenses.TEMPLATES["MIT"][3], licenses.TEMPLATES["BSD-2-Clause"][1]
    paragraphs = re.sub(r"(conditions:|Software\.) ", r"\1\n\n", mit)
    cases = {
        "Intro line\nReleased under the MIT License.\nmore": ["MIT"], mit.upper().replace(",", " ,\n"): ["MIT"], "Licensed under the Apache License,  version 2.0": ["Apache-2.0"],
        "we licensed a house under the old oak": [], "": [], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"], "x Licensed under CC BY 3.0. y": ["CC-BY-3.0"], "Licensed under CC BY 2.0.": [],
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"], "This project is released under the MIT License by Foo Inc.": ["MIT"],
        "import x\n\n" + "".join(f"# {line}\n" for line in paragraphs.split("\n")) + "\n\ndef f(): pass\n" * 5: ["MIT"], bsd + " " + mit: ["BSD-2-Clause", "MIT"],
        " ".join(w for k, w in enumerate(mit.split()) if k % 20): ["MIT"], "version 3 " * 30 + "license": [], "License": [], "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        licenses.TEMPLATES["GPL-3.0"][2]: ["GPL-3.0"], licenses.TEMPLATES["GPL-3.0"][2].split(" This program is dist")[0]: None,
    }
    advertising = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Example Project. 4. Neither"
    cases |= {
        licenses.TEMPLATES["BSD-3-Clause"][1].replace("3. Neither", advertising): ["BSD-4-Clause"], licenses.TEMPLATES["BSD-3-Clause"][1]: ["BSD-3-Clause"],
        "This is not licensed under the GNU General Public License, version 3.": [], "It isn't licensed under the MIT License.": [], "not released under the MIT License": [],
        "DO NOT EDIT. Licensed under the MIT License.": ["MIT"], "This project is MIT licensed.": ["MIT"], "// SPDX-License-Identifier: MIT\nint x;": ["MIT"],
        "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"], "SPDX-License-Identifier: LicenseRef-Own": [], "SPDX-License-Identifier: CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
        "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,": ["GPL-2.0"], licenses.TEMPLATES["MPL-2.0"][1]: ["MPL-2.0"],
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": ["Apache-2.0"],
    }
    made = list(cases) + [None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, passages string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(made):
        want = licence_passages(t)
        assert [(p["license"], p["dice"], p["start"], p["words"]) for p in got[i]["passages"]] == want, t
        assert got[i]["n_passages"] == len(want) and got[i]["licenses"] == sorted({w[0] for w in want}) and got[i]["best_license"] == (want[0][0] if want else None)
        if t is not None and cases[t] is not None:
            assert got[i]["licenses"] == cases[t], t
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r["n_passages"] for r in licenses.scan(docs_).collect()}
    known = [set(licenses.python_bigrams(licenses.python_words(t))) for ts in licenses.TEMPLATES.values() for t in ts]
    for i, t in rows(docs_.select("doc_id", "text")):
        lines = [g for u in t.split("\n") if len(g := set(licenses.python_bigrams(licenses.python_words(u)))) > 1]
        assert found[i] > 0 or all(2 * len(g & k) < 0.8 * (len(g) + len(k)) for g in lines for k in known), i


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_embeddings(spark, block_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vs = [*base, *(base[i % 30] + rng.normal(size=16) * 0.12 for i in range(60)), *(base[:5] * 3), *base[:5]]
    data = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 90 else 0) for i, v in enumerate(vs)]
    data += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, data[0][1], None), (205, [1.0, 2.0], 0), (206, [], 0), (0, data[0][1], 0), (None, data[3][1], 0)]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, label int, copies int")
    fit = [i for i, (_, v, l) in enumerate(data) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = []
    for x in fit:
        for y in fit:
            if y < x and data[x][2] == data[y][2] and len(data[x][1]) == len(data[y][1]):
                a, b = np.array(data[x][1]), np.array(data[y][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    pairs.append((x, y))
    assert len(pairs) > 20
    root, low = components(pairs, len(data)), {}
    for i, r in enumerate(root):
        if data[i][0] is not None:
            low[r] = min(low.get(r, data[i][0]), data[i][0])
    want = [(d[0], sum(i in p for p in pairs), low.get(root[i])) for i, d in enumerate(data)]
    got = embeddings.near_dups(df, block_rows=block_rows)
    assert sorted(repr(tuple(r)[:3]) for r in got.collect()) == sorted(map(repr, want))
    assert embeddings.near_dups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    root = components(pairs, 500)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root[n] for p in pairs for n in p}
