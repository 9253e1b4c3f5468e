"""The pipeline: each stage against brute force on what the stage before it kept, and the whole on odd tables."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from lattica.llm import bpe, common, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return sorted((repr(r["doc_id"]), r["text"] or "") for r in df.collect())


def near_roots(rows):
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    sizes = [len(s) for s in sets]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 0.8 * sizes[i] <= sizes[j] <= 1.25 * sizes[i] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_stages(spark, tmp_path):
    common.ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mix sources", "bpe"]
    made = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], SF).write.parquet(f"{tmp_path}/{i}")
        made.append(spark.read.parquet(f"{tmp_path}/{i}"))
    for df in made[1:-1]:
        assert df.columns == COLUMNS
    before, clean, once, apart, mixed, encoded = made
    # what the toxicity operator rejects is gone
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.score_documents(before, labels).filter("predicted = 1").select("doc_id").collect()}
    assert texts(clean) == [t for t in texts(before) if int(t[0]) not in rejected]
    # of equal texts the longest stays, then the smallest id
    best = {}
    for i, t in texts(clean):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60, "")), (-len(t), int(i), t))
    assert texts(once) == sorted((repr(i), t) for _, i, t in best.values())
    # of near copies the smallest id stays
    rows = sorted((int(i), t) for i, t in texts(once))
    assert texts(apart) == sorted((repr(rows[r][0]), rows[r][1]) for r in set(near_roots(rows)))
    # documents are there as often as the mix takes them, in the order of their positions
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(apart, whole_documents=True).collect()}
    got = [r["doc_id"] for r in mixed.collect()]
    assert {i: got.count(i) for i in copies} == copies
    # tokens as the library gives them
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path, pattern).rank, special_tokens={})
    want = sorted((i, len(ids := library.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((r["doc_id"], r["text"]) for r in mixed.collect()))
    assert sorted(tuple(r) for r in encoded.collect()) == want


def test_near_copies_recall(spark):
    """All pairs of the larger table at Jaccard 0.8 or more, found by comparing all with all, are in one group each; so are
    no two texts that such pairs don't join. Beside its own near copies some are made: words put in, left out, swapped."""
    common.ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"]]
    for i, t in rng.sample(rows, 60):
        words = t.split()
        for _ in range(rng.randrange(1, 2 + len(words) // 40)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"], [words[at - 1]]]) or ["x"]
        rows.append((1_000_000 + i, " ".join(words)))
    distinct = sorted({t: i for i, t in reversed(sorted(rows))}.items(), key=lambda e: e[1])
    rows = [(i, t) for t, i in distinct]
    roots = near_roots(rows)
    pairs = sum(r != i for i, r in enumerate(roots))
    assert pairs > 20
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(rows[r][0] for r in set(roots))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None, None, None, 1), (None, "", None, None, None, 1), (1, " \t\n", "en", None, 0, 2), (1, " \t\n", "en", None, 0, 2)],
    [(i % 3, "tie " * 30, "en", None, 1, i) for i in range(6)] + [(9, "word" + " long text" * 200_000, "en", "s", 1, 1), (None, "one", "en", "s", 1, 1)],
])
def test_odd_tables(spark, tmp_path, rows):
    """Nulls, empty and very long texts, ties, repeated rows, no rows, and columns with the operators' own names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score long").withColumnsRenamed({"lang": "_h"})
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert name == "bpe" or after.columns == docs.columns
        assert name == "mix sources" or after.count() <= docs.count()
        docs = after
    if not rows:
        assert docs.count() == 0
