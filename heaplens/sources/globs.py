"""Glob patterns over whole paths: one matcher for files that are listed in batch and for files that are followed."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import regex

#: A walk goes this many levels below its base at most.
MAX_DEPTH = 100
_META = set("\\*?[{")


def _closing(pattern: str, at: int) -> int:
    """The position of the brace that closes the one at ``at``."""
    depth, k = 0, at
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "{":
            depth += 1
        elif pattern[k] == "}":
            depth -= 1
            if not depth:
                return k
        k += 1
    raise ValueError(f"a brace isn't closed in {pattern!r}")


def expand(pattern: str) -> list[str]:
    """The patterns without braces that ``pattern`` stands for."""
    k = 0
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[" and "]" in pattern[k + 2 :]:
            k = pattern.index("]", k + 2)
        elif pattern[k] == "{":
            end = _closing(pattern, k)
            inner, parts, depth, skip = pattern[k + 1 : end], [""], 0, False
            for ch in inner:
                depth += (ch == "{") - (ch == "}") if not skip else 0
                if ch == "," and not depth and not skip:
                    parts.append("")
                else:
                    parts[-1] += ch
                skip = ch == "\\" and not skip
            return [x for part in parts for x in expand(pattern[:k] + part + pattern[end + 1 :])]
        k += 1
    return [pattern]


def _regex(pattern: str) -> str:
    """A regular expression, as Python and Java read it, for a pattern without braces."""
    out, k = "", 0
    plain = lambda ch: ch if ch.isalnum() or ch in "/_" or ord(ch) > 127 else "\\" + ch
    while k < len(pattern):
        ch = pattern[k]
        if ch == "\\":
            k += 1
            if k == len(pattern):
                raise ValueError(f"nothing follows the last backslash of {pattern!r}")
            out += plain(pattern[k])
        elif ch == "*":
            deep = pattern[k : k + 2] == "**"
            out += ".*" if deep else "[^/]*"
            k += deep
        elif ch == "?":
            out += "[^/]"
        elif ch == "[":
            if "]" not in pattern[k + 2 :]:
                raise ValueError(f"a bracket isn't closed in {pattern!r}")
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            negated, inner = inner[0] == "!", inner.removeprefix("!")
            body = "".join(c if c == "-" and 0 < i < len(inner) - 1 else plain(c) for i, c in enumerate(inner))
            out += f"(?!/)[{'^' * negated}{body}]"
            k = end
        else:
            out += plain(ch)
        k += 1
    return out


def _base(pattern: str) -> str:
    """The longest leading directory without wildcards."""
    parts = pattern.split("/")
    k = next((i for i, part in enumerate(parts[:-1]) if _META & set(part)), len(parts) - 1)
    return "/".join(parts[:k]) + "/"


class Glob:
    """A pattern over whole paths.

    ``*`` and ``?`` stay within one name (a leading dot is like any other character), ``**`` goes through directories, ``[a-z]`` and ``[!a-z]`` are one character of a name,
    ``{a,b}`` one of several patterns, which may hold all of these, and a backslash takes the next character as it is. A pattern may begin with a scheme; paths are compared without.
    """

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern
        self.alternatives = expand(pattern)
        #: fits whole paths, less their scheme and authority
        self.text = "(?s)(?:" + "|".join(_regex(strip_scheme(p)) for p in self.alternatives) + ")"
        self._compiled = regex.compile(self.text)
        self.bases = sorted({_base(p) for p in self.alternatives})

    def matches(self, path: str) -> bool:
        return self._compiled.fullmatch(path) is not None

    def may_hold(self, directory: str) -> bool:
        """Whether paths below ``directory`` can match: whether it begins a match."""
        return self._compiled.fullmatch(directory.rstrip("/") + "/", partial=True) is not None

    def roots(self) -> list[str]:
        """Patterns of what to list: each alternative up to the name in which directories may be passed through."""
        out = set()
        for p in self.alternatives:
            parts = p.split("/")
            k = next((i for i, part in enumerate(parts) if "**" in part), None)
            out.add(p if k is None else "/".join(parts[:k]) + "/")
        return sorted(out)


def strip_scheme(path: str) -> str:
    """The path without scheme and authority."""
    return regex.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?(?=/)", "", path)


def _inside(folder: str, above: tuple, failed: Callable[[str, OSError], None] | None = None) -> tuple[tuple[int, int], list[os.DirEntry]] | None:
    """Device and inode of a folder and its entries in order; None if it is gone, can't be listed (which is told to ``failed``) or is one of those ``above`` it."""
    try:
        s = os.stat(folder)
        me = (s.st_dev, s.st_ino)
        if me in above:
            return None
        with os.scandir(folder) as entries:
            return me, sorted(entries, key=lambda e: e.name)
    except FileNotFoundError:
        return None
    except OSError as error:
        if failed:
            failed(folder, error)
        return None


def hidden(name: str) -> bool:
    """Whether batch listing passes over a name, as Spark does."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.endswith("._COPYING_")


class Visible:
    """The files that batch listing shows for patterns without braces: those that match one, less hidden names, of files anywhere, of folders from a pattern's first ``**`` on."""

    def __init__(self, globs: Iterable[Glob]) -> None:
        self.globs = [(g, next((k for k, part in enumerate(strip_scheme(g.pattern).split("/")) if "**" in part), None)) for g in globs]
        self._any = regex.compile("|".join(g.text for g, _ in self.globs))

    def shows(self, path: str) -> bool:
        *folders, name = path.split("/")
        return not hidden(name) and any(g.matches(path) and not (k is not None and any(map(hidden, folders[k:]))) for g, k in self.globs)

    def bases(self) -> list[str]:
        bases = sorted({strip_scheme(b) for g, _ in self.globs for b in g.bases})
        return [b for b in bases if not any(b != a and b.startswith(a) for a in bases)]

    def look(self, folder: str, depth: int, above: tuple) -> tuple[list[os.DirEntry], list[tuple[str, int, tuple]]]:
        """The files that are shown of one folder, and the folders in it that can hold such, each with its depth and those above it. An error is raised, unless something is gone."""

        def failed(path: str, error: OSError) -> None:
            raise error

        inside = _inside(folder, above, failed)
        files, below = [], []
        for entry in inside[1] if inside else ():
            if entry.is_dir():
                if depth + 1 < MAX_DEPTH and self._any.fullmatch(entry.path + "/", partial=True):
                    below.append((entry.path, depth + 1, (*above, inside[0])))
            elif self.shows(entry.path) and entry.is_file():
                files.append(entry)
        return files, below


def walk(globs: Iterable[Glob], visit: Callable[[str], bool] | None = None, failed: Callable[[str, OSError], None] | None = None) -> Iterator[os.DirEntry | None]:
    """Regular files below the bases of ``globs`` that match one of them, each path once; links are followed.

    Only directories that can hold a match are entered, down to ``MAX_DEPTH`` levels below a base; one that is its own ancestor by a link isn't entered again, and one that can't be listed is told to ``failed`` and passed over. ``visit`` is
    asked for each entry that isn't a directory; for as long as it says no, the walk yields None, so that it may be gone on with later.
    """
    globs = list(globs)
    bases = sorted({b for g in globs for b in g.bases})
    bases = [b for b in bases if not any(b != a and b.startswith(a) for a in bases)]
    todo = [(base, 0, ()) for base in reversed(bases)]
    while todo:
        folder, depth, above = todo.pop()
        if (found := _inside(folder, above, failed)) is None:
            continue
        me, inside = found
        below = []
        for entry in inside:
            try:
                if entry.is_dir():
                    if depth + 1 < MAX_DEPTH and any(g.may_hold(entry.path) for g in globs):
                        below.append((entry.path, depth + 1, (*above, me)))
                    continue
                while visit and not visit(entry.path):
                    yield None
                if any(g.matches(entry.path) for g in globs) and entry.is_file():
                    yield entry
            except OSError as error:
                if failed:
                    failed(entry.path, error)
        todo += reversed(below)


def once(paths: Iterable[str]) -> dict[str, str]:
    """Each file once, by its canonical path: the path that is no link if it is among ``paths``, else the smallest."""
    best: dict[str, str] = {}
    for path in sorted(set(paths)):
        real = os.path.realpath(path)
        if real not in best or path == real:
            best[real] = path
    return best
