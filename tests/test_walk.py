"""The distributed walk on trees with odd names, links, circles and folders that can't be read."""

import os

import pytest

from foliant.sources import walk


@pytest.fixture
def tree(tmp_path):
    for rel in ("_Maps/a.txt", "ok/_c.txt", ".x/d.txt", "ok/b.txt", "ok/deep/er/e.bin", ".git/config", "ok/.GIT/x", "sp ace/ü.txt", "ok/skip.tmp"):
        path = tmp_path / "t" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(rel)
    (tmp_path / "t/empty").mkdir()
    (tmp_path / "away/in").mkdir(parents=True)
    (tmp_path / "away/in/f.txt").write_text("f")
    os.symlink(tmp_path / "away", tmp_path / "t/out")
    os.symlink(tmp_path / "away", tmp_path / "t/out2")
    os.symlink(tmp_path / "t", tmp_path / "t/ok/loop")
    os.symlink(tmp_path / "gone", tmp_path / "t/dead")
    return tmp_path


def rows(frame, kind=None):
    return sorted((r.rel, r.kind) for r in frame.collect() if kind is None or r.kind == kind)


def test_all_names_links_and_excludes(spark, tree):
    got = walk.walk(spark.createDataFrame([(str(tree / "t"),), (str(tree / "t"),), (None,)], "root string"), any_case=True, globs=("*.tmp", "ok/deep/er/"))
    assert rows(got) == sorted([
        ("_Maps", "dir"), ("_Maps/a.txt", "file"), ("ok", "dir"), ("ok/_c.txt", "file"), (".x", "dir"), (".x/d.txt", "file"), ("ok/b.txt", "file"), ("ok/deep", "dir"), ("ok/deep/er", "excluded"),
        (".git", "excluded"), ("ok/.GIT", "excluded"), ("sp ace", "dir"), ("sp ace/ü.txt", "file"), ("ok/skip.tmp", "excluded"), ("empty", "dir"), ("out", "link"), ("out2", "link"), ("ok/loop", "link"), ("dead", "link"),
    ])
    one = got.filter("rel = 'sp ace/ü.txt'").first()
    at = os.stat(tree / "t/sp ace/ü.txt")
    assert (one.name, one.size, one.inode, one.dev) == ("ü.txt", at.st_size, at.st_ino, at.st_dev) and abs(one.mtime - at.st_mtime) < 1e-3


def test_links_are_followed_once(spark, tree):
    got = walk.walk(spark.createDataFrame([(str(tree / "t"),)], "root string"), follow=True)
    files = [r for r, _ in rows(got, "file")]
    assert "out/in/f.txt" in files and "out2/in/f.txt" not in files and not [f for f in files if f.startswith("ok/loop/")]
    assert len(files) == len(set(files))


def test_bad_roots_are_rows(spark, tree):
    bad = [str(tree / "nowhere"), str(tree / "t/ok/b.txt")]
    got = walk.walk(spark.createDataFrame([(b,) for b in [*bad, "file:" + str(tree / "away")]], "root string")).collect()
    assert {(r.root, r.rel, r.kind, r.error.split(":")[0]) for r in got if r.kind == "error"} == {(bad[0], "", "error", "FileNotFoundError"), (bad[1], "", "error", "NotADirectoryError")}
    assert {r.rel for r in got if r.kind == "file"} == {"in/f.txt"}
    assert walk.walk(spark.createDataFrame([], "root string")).count() == 0


def test_a_folder_that_cannot_be_read(spark, tree, monkeypatch):
    """The listing of one folder fails (a root user may read anything, so the failure is made)."""
    listing = os.scandir

    def refused(path):
        if str(path).endswith("/deep"):
            raise PermissionError(13, "Permission denied")
        return listing(path)

    monkeypatch.setattr(walk.os, "scandir", refused)
    got = list(walk._listed(str(tree / "t/ok/deep"), False))
    assert got == [("", "error", None, None, None, None, None, "PermissionError: Permission denied")]
    assert {name for name, *_ in walk._listed(str(tree / "t/ok"), False)} == {"_c.txt", "b.txt", "deep", ".GIT", "skip.tmp", "loop"}


def test_other_file_systems(tree):
    import pyarrow.fs

    found = {(n, k) for n, k, *_ in walk._remote(pyarrow.fs.LocalFileSystem(), str(tree / "t/_Maps"), "store://x/_Maps")}
    assert found == {("a.txt", "file")}
