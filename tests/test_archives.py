"""Members of archives, cut into stretches or streamed, against the lines of their texts."""

import io
import random
import tarfile
import zipfile

import pytest
from lattica.sources import archives, files


def wanted(text: str) -> list[str]:
    return [line.rstrip("\n") for line in io.StringIO(text, newline=None)]


def texts() -> dict[str, str]:
    rng = random.Random(3)
    ends = ["\n", "\r\n", "\r", "\n\n"]
    long = "".join("é9\U0001d400"[rng.randrange(3)] * rng.randrange(12) + rng.choice(ends) for _ in range(300))
    return {"d/long.txt": long, "d/one.txt": "no end", "d/none.txt": "", "d/blank.txt": "\n\n\n", "e/one.txt": "x" * 500 + "\ny"}


def add(t: tarfile.TarFile, name: str, text: str) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(text.encode())
    t.addfile(info, io.BytesIO(text.encode()))


@pytest.mark.parametrize("kind", ["tar", "tar.gz", "tar.bz2"])
@pytest.mark.parametrize("stretch", [1, 7, 64, archives.STRETCH])
def test_tar(spark, tmp_path, kind, stretch):
    path = tmp_path / f"a.{kind}"
    with tarfile.open(path, "w:" + kind.removeprefix("tar").removeprefix(".")) as t:
        for name, text in texts().items():
            add(t, name, text)
    reader = archives._Reader({"path": str(path), "stretch": str(stretch)})
    got: dict[str, list[str]] = {}
    for part in reader.partitions():  # what Spark's tasks do, in their order
        for batch in reader.read(part):
            for r in batch.to_pylist():
                got.setdefault(r["member"], []).append(r["value"])
    assert got == {name: wanted(text) for name, text in texts().items() if text}
    if stretch == 64:
        rows = files.numbered(archives.read(spark, str(path), "one.txt", stretch)).orderBy("n").collect()
        assert [(r["member"], r["value"]) for r in rows] == [("d/one.txt", "no end"), ("e/one.txt", "x" * 500), ("e/one.txt", "y")]
        assert archives.read(spark, str(path), "missing.txt").count() == 0
        assert (archives.read(spark, str(path), None, stretch).rdd.getNumPartitions() > 4) == (kind == "tar")


def test_small_members_share_tasks(spark, tmp_path):
    for archive in ("a.tar", "b.tar"):
        with tarfile.open(tmp_path / archive, "w") as t:
            for i in range(500):
                add(t, f"{i}.txt", f"{archive} {i}\n")
    got = archives.read(spark, str(tmp_path), stretch=1000)
    assert got.rdd.getNumPartitions() == 10  # 9,780 bytes
    assert [r["value"] for r in got.collect()] == [f"{a} {i}" for a in ("a.tar", "b.tar") for i in range(500)]


@pytest.mark.parametrize("how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_zip(spark, tmp_path, how):
    for name in ("a.zip", "b.zip"):
        with zipfile.ZipFile(tmp_path / name, "w", how) as z:
            for member, text in texts().items():
                z.writestr(member, text)
            z.writestr("d/x_homo_sapiens.bin", "human\n" if name == "a.zip" else "also")
            if name == "b.zip":
                z.writestr("z/9606.tsv", "b\r\nc")
    pick = {"a.zip": ["human"], "b.zip": ["b", "c"]}
    for name, lines in pick.items():
        assert [r["value"] for r in files.read_lines(spark, str(tmp_path / name)).collect()] == lines
    for path in (str(tmp_path), f"{tmp_path}/*.zip", f"file:{tmp_path}", f"file://{tmp_path}/?.zip"):
        rows = archives.read(spark, path, stretch=2).collect()
        assert [r["value"] for r in rows] == ["human", "b", "c"] and {r["archive"].rsplit("/", 1)[-1] for r in rows} == set(pick)
    named = archives.read(spark, str(tmp_path / "a.zip"), "long.txt", 50)
    assert [r["value"] for r in files.numbered(named).orderBy("n").collect()] == wanted(texts()["d/long.txt"])
    assert (named.rdd.getNumPartitions() > 10) == (how == zipfile.ZIP_STORED)


def test_what_cannot_be_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    assert files.read_lines(spark, str(tmp_path / "empty.zip")).count() == 0
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "bad.tar.gz").write_bytes(b"no archive")
    for path in ("bad.zip", "bad.tar.gz", "absent.zip"):
        with pytest.raises(Exception):  # noqa: B017  whatever the reader raises
            archives.read(spark, str(tmp_path / path)).count()
