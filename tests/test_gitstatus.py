"""Statuses from a real listing, where git is there, and from lines."""

import shutil
import subprocess

import pytest

from assetloom.sources import gitstatus


def test_lines(spark, tmp_path):
    lines = [" M a.png", "M  b.png", "MM c.png", "A  d.png", "AM e.png", "?? f.png", "!! g.png", " D h.png", "D  i.png", "R  old.png -> new.png", 'R  "a b.png" -> "c\\td.png"', "UU j.png", "AA k.png", " T l.png", '?? "\\303\\251 x.png"', '?? "q\\"r.png"', "", "nonsense", "?? x -> y.png", " M a.png", "M  crlf.png\r"]
    (tmp_path / "s.txt").write_bytes("\n".join(lines).encode())
    got = {r["path"]: r["status"] for r in gitstatus.read_statuses(spark, f"{tmp_path}/s.txt", "/p/").collect()}
    want = {
        "a.png": "modified", "b.png": "modified", "c.png": "modified", "d.png": "new", "e.png": "new", "f.png": "untracked", "g.png": "ignored", "h.png": "deleted", "i.png": "deleted", "new.png": "renamed", "c\td.png": "renamed",
        "j.png": "conflicted", "k.png": "conflicted", "l.png": "typechange", "é x.png": "untracked", 'q"r.png': "untracked", "x -> y.png": "untracked", "crlf.png": "modified",
    }
    assert got == {f"/p/{k}": v for k, v in want.items()}


@pytest.mark.skipif(shutil.which("git") is None, reason="no git here")
def test_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y.zz", "-C", str(tmp_path / "r"), *a], check=True, capture_output=True, text=True).stdout
    (tmp_path / "r").mkdir()
    git("init", "-q")
    for name in ("a.png", "b c.png", "gone.png", "é.png"):
        (tmp_path / "r" / name).write_text(name * 9)
    git("add", "-A")
    git("commit", "-qm", "x")
    git("mv", "b c.png", "d e.png")
    (tmp_path / "r/a.png").write_text("changed")
    (tmp_path / "r/gone.png").unlink()
    (tmp_path / "r/é.png").write_text("changed")
    (tmp_path / "r/sub").mkdir()
    (tmp_path / "r/sub/new ü.png").write_text("x")
    (tmp_path / "s.txt").write_text(git("status", "--porcelain", "--untracked-files=all"))
    got = {r["path"]: r["status"] for r in gitstatus.read_statuses(spark, f"{tmp_path}/s.txt", "/r").collect()}
    assert got == {"/r/a.png": "modified", "/r/d e.png": "renamed", "/r/gone.png": "deleted", "/r/é.png": "modified", "/r/sub/new ü.png": "untracked"}
