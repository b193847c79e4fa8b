"""The glob matcher and what lists files by it, in batch and in the following source."""

import os
import pathlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heaplens.sources.globs import Glob, expand, walk
from heaplens.sources.lines import list_files, read_lines
from heaplens.sources.tail import TailReader


@pytest.mark.parametrize("pattern, yes, no", [
    ("/l/*.log", ["/l/a.log", "/l/.log", "/l/.a.log"], ["/l/x/a.log", "/l/a.txt", "/l/a.logx", "/k/a.log"]),
    ("/l/gc?.log", ["/l/gc1.log", "/l/gcé.log"], ["/l/gc.log", "/l/gc/.log", "/l/gc12.log"]),
    ("/l/**/gc.log", ["/l/a/gc.log", "/l/a/b/gc.log"], ["/l/gc.log", "/l/gc.log/x"]),
    ("/l/**.log", ["/l/a.log", "/l/a/b/c.log"], ["/l/a.txt"]),
    ("/l/{a,b*}.log", ["/l/a.log", "/l/b.log", "/l/bcd.log"], ["/l/c.log", "/l/a,b.log"]),
    ("/l/{app/{x,y},web}/gc.log", ["/l/app/x/gc.log", "/l/app/y/gc.log", "/l/web/gc.log"], ["/l/app/gc.log", "/l/x/gc.log"]),
    ("/l/[a-c]1.log", ["/l/b1.log"], ["/l/d1.log", "/l/-1.log"]),
    ("/l/[!a-c]1.log", ["/l/d1.log"], ["/l/b1.log", "/l//1.log"]),
    ("/l/[*?\\]x", ["/l/*x", "/l/?x", "/l/\\x"], ["/l/ax"]),
    (r"/l/\*\{a\}.log", ["/l/*{a}.log"], ["/l/x{a}.log", "/l/*a.log"]),
    ("/l/a+b(1)$^|&.log", ["/l/a+b(1)$^|&.log"], ["/l/aab1.log"]),
    ("hdfs://nn:8020/l/*.log", ["/l/a.log"], ["/a.log"]),
])
def test_matches(spark, pattern, yes, no):
    glob = Glob(pattern)
    assert [p for p in yes if not glob.matches(p)] == [] and [p for p in no if glob.matches(p)] == []
    # Spark's own expressions read the same expression
    found = spark.createDataFrame([(p,) for p in yes + no], "p string").where(f"p RLIKE {'^' + glob.text + '$'!r}") if "\\" not in glob.text else None
    assert found is None or sorted(r.p for r in found.collect()) == sorted(yes)
    # each directory above a match may hold it
    assert all(glob.may_hold("/".join(p.split("/")[:k])) for p in yes for k in range(1, p.count("/") + 1))


def test_bases_and_errors():
    assert Glob("/var/log/*/gc.log").bases == ["/var/log/"] and Glob("/var/{log,tmp}/x*").bases == ["/var/log/", "/var/tmp/"]
    assert Glob("/a/b/c.log").bases == ["/a/b/"] and Glob("/*").bases == ["/"]
    assert not Glob("/var/log/*/gc.log").may_hold("/var/log/a/b") and not Glob("/var/log/*/gc.log").may_hold("/home")
    assert Glob("/a/*/b**/c").roots() == ["/a/*/"] and Glob("/a/{b,c}/d").roots() == ["/a/b/d", "/a/c/d"]
    assert expand("a{b,c{d,e}}f") == ["abf", "acdf", "acef"] and expand("a[{,}]b") == ["a[{,}]b"] and expand(r"\{a,b\}") == [r"\{a,b\}"]
    for bad in ("/a/{b", "/a/[b", "/a/b\\"):
        with pytest.raises(ValueError):
            Glob(bad)


names = st.text("ab.*?[]{},!-\\", min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(names, min_size=1, max_size=3))
def test_escaped_names_match_themselves_only(parts):
    """A path with each character escaped matches that path and nothing else."""
    path = "/" + "/".join(parts)
    glob = Glob("".join(c if c == "/" else "\\" + c for c in path))
    assert glob.matches(path) and not glob.matches(path + "a") and not glob.matches("/x" + path)


@pytest.fixture
def tree(tmp_path):
    """Ten logs, a tree with a link to a file, links to folders, a loop, a dangling link and names with odd characters."""
    for k in range(10):
        (tmp_path / f"test-glob{k}.log").write_text(f"top {k}\n")
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "gc.log").write_text("deep\n")
    (tmp_path / "a" / "gc.log").write_text("a\n")
    (tmp_path / "a" / "odd name+1%20{x}.log").write_text("odd\n")
    os.symlink(tmp_path / "a" / "gc.log", tmp_path / "current.log")
    os.symlink(tmp_path / "a", deep / "loop")
    os.symlink(deep, tmp_path / "short")
    os.symlink(tmp_path / "none", tmp_path / "dangling.log")
    return tmp_path


CASES = {
    "test-glob*.log": 10, "test-glob{0,1,7}.log": 3, "test-glob[2-4].log": 3, "**/gc.log": 2, "**.log": 13, "{a,short}/gc.log": 2, "a/*/*/gc.log": 1, "a/odd name+1%20\\{x\\}.log": 1, "a/odd*": 1, "current.log": 1, "none/*.log": 0,
}


def test_batch_and_stream_find_the_same(spark, tree):
    """Each file counts once, by whatever links, repeats and overlapping patterns it is found."""
    for pattern, count in CASES.items():
        listed = {os.path.realpath(r.path) for r in list_files(spark, f"{tree}/{pattern}").collect()}
        followed = TailReader({"globs": f"{tree}/{pattern}"}).files()
        assert len(listed) == len(followed) == count and listed == {os.path.realpath(p) for p in followed}, pattern
    both = [f"{tree}/test-glob*.log", f"{tree}/test-glob{{1,2}}.log", f"{tree}/test-glob*.log", f"{tree}/current.log", f"{tree}/a/gc.log"]
    assert list_files(spark, both).count() == 11 == len(TailReader({"globs": ",".join(both)}).files())
    lines = read_lines(spark, both)
    assert lines.count() == 11 and lines.where("line = 'a'").select("path").collect()[0].path == f"{tree}/a/gc.log"
    assert [(r.path, r.line) for r in read_lines(spark, f"{tree}/a/odd*").collect()] == [(f"{tree}/a/odd name+1%20{{x}}.log", "odd")]
    assert read_lines(spark, f"{tree}/none/*").count() == 0 and read_lines(spark, []).count() == 0


def test_walk(tmp_path, tree):
    entered = []
    scandir = os.scandir
    os.scandir = lambda p: entered.append(pathlib.Path(p).name) or scandir(p)
    try:
        assert [e.name for e in walk([Glob(f"{tree}/a/b/*/gc.log")])] == ["gc.log"]
    finally:
        os.scandir = scandir
    assert entered == ["b", "c"]  # nothing beside the base and what can match is entered
    asked = []
    found = list(walk([Glob(f"{tree}/*.log")], visit=lambda p: asked.append(p) or len(asked) % 2 == 0))  # every other answer is no
    assert len(asked) == 2 * 12 and found.count(None) == 12 and len(found) == 12 + 11
    deep = tmp_path / "deep"
    for _ in range(102):
        deep = deep / "d"
    deep.mkdir(parents=True)
    (deep / "x.log").write_text("x\n")
    (tmp_path / "deep" / "d" / "x.log").write_text("x\n")
    assert len(list(walk([Glob(f"{tmp_path}/deep/**/x.log")]))) == 1  # the other is more than a hundred levels down
