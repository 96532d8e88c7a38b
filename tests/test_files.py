"""Files on disk: listing, fingerprints of any size, failures as rows, records from paths."""

import hashlib
import os

import pytest

from folioflow.functions.text import lit
from folioflow.operators import inspection, routing
from folioflow.sources import corpus, files

SPARSE = 3 << 30


def test_every_file_at_any_depth(spark, tmp_path):
    for k, name in enumerate(["a.pdf", "sub/b.PDF", "sub/deep/er/c.txt", "other/.hidden", "sub/no extension"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * k)
    (tmp_path / "empty folder").mkdir()
    got = {r.path: (r["name"], r.extension, r.size_bytes, r.sha256, r.error) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {
        f"{tmp_path}/{name}": (name.rpartition("/")[2], extension, k, hashlib.sha256(b"x" * k).hexdigest(), None)
        for k, (name, extension) in enumerate([("a.pdf", "PDF"), ("sub/b.PDF", "PDF"), ("sub/deep/er/c.txt", "TXT"), ("other/.hidden", "FILE"), ("sub/no extension", "FILE")])
    }
    assert [r["name"] for r in files.scan_files(spark, f"file://{tmp_path}", "*.txt").collect()] == ["c.txt"]
    assert files.scan_files(spark, f"{tmp_path}/empty folder").collect() == []


def test_failures_are_rows_with_their_cause(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"good")
    os.symlink("/proc/self/mem", tmp_path / "broken.pdf")  # a file whose first byte cannot be read
    os.mkfifo(tmp_path / "pipe.pdf")
    got = {r["name"]: (r.sha256, r.error) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got["good.pdf"] == (hashlib.sha256(b"good").hexdigest(), None)
    assert got["broken.pdf"] == (None, os.strerror(5))
    assert got["pipe.pdf"] == (None, files.NOT_A_FILE)
    nowhere = files.scan_files(spark, f"{tmp_path}/nowhere").first()
    assert (nowhere.sha256, nowhere.error) == (None, os.strerror(2))
    unknown = files.examine(spark.createDataFrame([("nosuchstore://x/y.pdf",)], "path string")).first()
    assert not unknown.is_file and "nosuchstore" in unknown.error


def test_a_listed_file_that_vanishes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a")
    listed = files.list_files(spark, str(tmp_path))
    (tmp_path / "a.pdf").unlink()
    row = files.examine_evenly(listed).first()
    assert (row.is_file, row.error) == (False, os.strerror(2))


def test_a_file_over_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.pdf", "wb") as out:
        out.truncate(SPARSE)
    want = hashlib.sha256()
    for _ in range(SPARSE >> 24):
        want.update(bytes(1 << 24))
    row = files.scan_files(spark, str(tmp_path)).first()
    assert (row.size_bytes, row.sha256, row.error) == (SPARSE, want.hexdigest(), None)


def test_written_files_are_whole_and_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("/a/b.pdf", "eins"), ("c.pdf", "")], "path string, content string")
    for _ in range(2):
        assert files.write_files(rows, str(tmp_path)) == 2
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/b.pdf", "c.pdf"]
    assert (tmp_path / "a/b.pdf").read_text() == "eins"


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inbox"))
    files.write_files(corpus.inbox(spark, sf), root)
    return root


def test_records_from_paths_equal_records_from_rows(spark, sf, folder):
    given = corpus.delivered(spark, sf, 0)
    found = inspection.inspect_files(given.selectExpr(f"concat({lit(folder)}, path) as path", "seq"), given.selectExpr(f"concat({lit(folder)}, path) as path", *given.columns[4:]))
    want = {r.path: r for r in routing.inspect(given.withColumn("size_bytes", given.size_bytes % 16777216), keep=("seq",)).collect()}
    got = {r.path.removeprefix(folder): r for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == given.count()
    assert sorted(set(r.route for r in got.values())) == list("acdeghijkl")
    for path, row in want.items():
        mine = got[path].asDict(recursive=True) | {"path": path}
        ours = row.asDict(recursive=True)
        for r in (mine, ours):
            del r["modified_at"]
        if row.route == "l":
            failed = f"Inspection failed: {os.strerror(2)}"
            assert (mine["status"], mine["note"], mine["analysis"]["summary"]) == ("Error", failed, failed)
        else:
            assert mine == ours


def test_requested_paths_without_texts(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"abc")
    (tmp_path / "folder.pdf").mkdir()
    os.symlink("/proc/self/mem", tmp_path / "broken.pdf")
    wanted = [f"{tmp_path}/{n}" for n in ("a.docx", "folder.pdf", "broken.pdf", "absent.pdf", "a.docx", "no.exe")]
    got = {r.path.rpartition("/")[2]: r for r in inspection.inspect_files(spark.createDataFrame(list(enumerate(wanted)), "seq long, path string")).collect()}
    assert {n: (r.seq, r.status, r.size_bytes) for n, r in got.items()} == {"a.docx": (0, "Metadata only", 3), "folder.pdf": (1, "Error", 0), "broken.pdf": (2, "Error", 0), "absent.pdf": (3, "Error", 0)}
    assert got["a.docx"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["a.docx"].modified_at is not None
    notes = {n: r.note for n, r in got.items()}
    assert notes["folder.pdf"] == "Inspection failed: path is not a regular file."
    assert (notes["broken.pdf"], notes["absent.pdf"]) == tuple(f"Inspection failed: {os.strerror(n)}" for n in (5, 2))
    assert inspection.inspect_files(spark.createDataFrame([], "seq long, path string")).collect() == []
