"""Snapshots against a plain loop over each listing, and scans of folders written here."""

import os
import random

import pytest
from pyspark.sql import functions as F

from marksheet.sources import snapshots as SN
from marksheet.sources.tables import written

LISTING = "project_id int, pos long, raw string, kind string, size long"
SMALL = SN.Limits(files=9, folders=3, total_bytes=1200, file_bytes=300, git_files=2, git_bytes=500)


def plain(rows, lim):
    """One project as a loop in listing order: ({pos: fate}, {pos: conflict}, reason, at, files, bytes, tops)."""
    owner, files, made = {}, set(), set()
    fates, clashes, count, total, folders, tops = {}, {}, 0, 0, 0, {}
    reason = at = None
    above = lambda parts: ["/".join(parts[:i]) for i in range(1, len(parts))]
    for pos, raw, kind, size in sorted(rows):
        parts = [p for p in raw.replace("\\", "/").split("/") if p not in ("", ".")]
        path, folder = "/".join(parts), kind == "directory"
        if ".." in parts or raw.startswith("/"):
            fates[pos] = "unsafe"
            reason, at = (reason, at) if reason else ("unsafe:" + ("absolute" if raw.startswith("/") else "escaping"), pos)
            continue
        if not path:
            fates[pos] = "root"
            continue
        special = next((p for p in (parts if folder else parts[:-1]) if p in (".git", "venv", "__MACOSX")), None)
        if any(p in ("aux", "x ", "q?") for p in parts) or special == "__MACOSX" or not special and not folder and parts[-1] == ".git":
            fates[pos] = "skipped"
            continue
        if special:
            fates[pos] = "git" if special == ".git" else "placeholder"
            if special == ".git" and folder:
                made |= {*above(parts), path}
            continue
        why = None
        for parent in above(parts):
            if parent in files:
                why = f"its parent '{parent}' is a file"
            elif owner.get(parent.lower(), parent) != parent:
                why = f"folder '{parent}' differs only by letter case from '{owner[parent.lower()]}'"
            if why:
                break
        mine = owner.get(path.lower())
        if not why and mine is not None and not (mine == path and folder and path not in files):
            why = "duplicate entry" if mine == path else f"differs only by letter case from '{mine}'"
        if why:
            fates[pos], clashes[pos] = "conflict", why + ", not copied"
            continue
        for p in [*above(parts), path]:
            owner.setdefault(p.lower(), p)
        if folder:
            fates[pos] = "keep"
            if path not in made:
                folders += 1
            made |= {*above(parts), path}
        else:
            files.add(path)
            if size > lim.file_bytes:
                fates[pos] = "too_large"
                continue
            fates[pos] = "keep"
            made |= set(above(parts))
            if not reason:
                count, total = count + 1, total + size
                tops[parts[0]] = tops.get(parts[0], 0) + 1
        if not reason:
            over = "too_many_files" if count > lim.files else "too_large" if total > lim.total_bytes else "too_many_folders" if folders > lim.folders else None
            reason, at = (over, pos) if over else (None, None)
    heavy = ", ".join(f"{k}:{n}" for k, n in sorted(tops.items(), key=lambda t: (-t[1], t[0]))[:3]) if reason in ("too_many_files", "too_large") else ""
    return fates, clashes, reason, at, count, total, heavy


def test_listings_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(SN, "BLOCK", 4)
    rng, rows = random.Random(7), []
    names = ["a", "A", "b", "B", "c", "a", "b", "aux", "x ", "q?", ".git", "venv", "__MACOSX", "d", "e", "f", "g"]
    for project in range(120):
        wide = names[: rng.choice([4, 7, 17])] if project % 2 else ["a", "b", "d", "e", "f", "g", "h", "i"]
        for pos in range(rng.choice([1, 4, 12, 30])):
            raw = "/".join(rng.choice(wide) for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
            raw = rng.choice([raw] * 12 + ["./" + raw, raw.replace("/", "\\"), raw + "/", ".", *(["../x", "/" + raw] if rng.random() < 0.3 else [])])
            rows.append((project, pos * 3, raw, rng.choice(["file", "file", "directory"]), rng.choice([0, 10, 50, 400])))
    entries = written(SN.snapshot_entries(spark.createDataFrame(rows, LISTING).repartition(5), SMALL), "entries")
    got, whole = entries.collect(), {r.project_id: r for r in SN.snapshot_projects(entries, SMALL).collect()}
    seen = set()
    for project in range(120):
        fates, clashes, reason, at, count, total, heavy = plain([r[1:] for r in rows if r[0] == project], SMALL)
        assert {r.pos: r.fate for r in got if r.project_id == project} == fates
        assert {r.pos: r.note for r in got if r.project_id == project and r.fate == "conflict"} == clashes
        p = whole[project]
        assert (p.status, p.reason, p.at_pos, p.files, p.total_bytes, p.heaviest) == ("rejected" if reason else "ok", reason, at, count, total, heavy)
        seen |= {*fates.values(), reason}
    assert {"keep", "git", "placeholder", "skipped", "conflict", "too_large", "root", "unsafe", None, "too_many_files", "too_many_folders"} <= seen


@pytest.mark.parametrize(("name", "want"), [("ok.py", None), ("a\x01", "control character in the name"), ("b?:a", "character(s) : ? not allowed in file names"), ("end.", "name ending with a space or a dot"), ("end ", "name ending with a space or a dot"), ("Com1.txt", "reserved device name 'COM1'"), ("lpt² .x", "reserved device name 'LPT²'"), ("comic", None)])
def test_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(SN.name_problem(F.col("n"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("a/b", None), ("/a", "absolute"), ("\\\\srv\\a", "absolute"), ("c:x", "absolute"), ("a/../b", "escaping"), ("a..b", None), ("a\0", "nul")])
def test_unsafe_paths(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(SN.unsafe(F.col("n"))).first()[0] == want


def test_nulls_and_an_empty_table(spark):
    got = SN.snapshot_entries(spark.createDataFrame([(1, 0, None, "file", None), (1, 1, "a", "file", None), (None, 2, "b", "file", 1)], LISTING)).collect()
    assert sorted((r.pos, r.fate) for r in got) == [(0, "root"), (1, "keep"), (2, "keep")]
    empty = written(SN.snapshot_entries(spark.createDataFrame([], LISTING)), "entries")
    assert empty.count() == 0 and SN.snapshot_projects(empty).count() == 0 and SN.snapshot_tree(empty, SN.snapshot_projects(empty)).count() == 0


def test_a_folder_is_scanned_and_read(spark, tmp_path):
    for path, text in {"src/main.py": "x = 1", "src/__init__.py": "", "src/__pycache__/main.pyc": "?", ".hidden": "h", "Read Me.md": "r", "venv/lib/x.py": "no", "Src2/a/b.txt": "b"}.items():
        (tmp_path / "p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / path).write_text(text)
    os.symlink(tmp_path / "p" / "src", tmp_path / "p" / "link")
    (tmp_path / "none").mkdir()
    folders = spark.createDataFrame([(1, f"file://{tmp_path}/p"), (2, f"file://{tmp_path}/none")], "project_id int, folder string")
    listing = SN.list_folders(folders)
    want = [".hidden", "Read Me.md", "Src2", "link", "src", "venv", "src/__init__.py", "src/__pycache__", "src/main.py", "src/__pycache__/main.pyc", "Src2/a", "Src2/a/b.txt"]
    assert [r.raw for r in listing.orderBy("project_id", "pos").collect()] == want
    entries = written(SN.snapshot_entries(listing), "entries")
    assert {r.path: r.fate for r in entries.collect() if r.fate != "keep"} == {"link": "skipped", "venv": "placeholder"}
    tree = SN.snapshot_tree(entries, SN.snapshot_projects(entries)).orderBy("place").collect()
    assert [(r.path, r.kind) for r in tree] == [(".hidden", "file"), ("Read Me.md", "file"), ("src", "directory"), ("src/__init__.py", "file"), ("src/__pycache__", "directory"), ("src/__pycache__/main.pyc", "file"), ("src/main.py", "file"), ("Src2", "directory"), ("Src2/a", "directory"), ("Src2/a/b.txt", "file"), ("venv", "directory")]
    read = SN.read_contents(entries.where("fate = 'keep' and kind = 'file'").join(folders, "project_id"))
    assert {r.path: bytes(r.content).decode() for r in read.collect()} == {"src/main.py": "x = 1", "src/__init__.py": "", "src/__pycache__/main.pyc": "?", ".hidden": "h", "Read Me.md": "r", "Src2/a/b.txt": "b"}
