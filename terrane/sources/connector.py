"""A Python data source over recorded API pages: the network stays outside, its answers come in as files.

Pages lie in ``<folder>/unit=<unit>/page=<number>/``, one JSON object {unit, page, items} a page. The source plans its work from the paths alone: filters on
``unit`` and ``page`` (done units, windows, pages already taken) drop pages before any is opened, and what is left is dealt to partitions of a bounded number of
pages. As a stream its offsets are the progress marks, the last page taken of each unit, so a restarted query goes on after them.

``register(spark)``, then ``spark.read.format("recorded").option("path", folder).load().filter(...)`` or ``spark.readStream.format("recorded")``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not,
)

PAGE_PATH = re.compile(r"/unit=([^/]*)/page=(\d+)/[^/_.][^/]*$")
#: Pages that one partition reads.
PAGES_A_TASK = 16


@dataclass(frozen=True)
class Page:
    unit: str
    number: int
    path: str


class Pages(InputPartition):
    def __init__(self, pages: tuple[Page, ...]):
        self.pages = pages


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder lies in, by its scheme, and its path there."""
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def _listed(folder: str) -> list[Page]:
    """All pages of the folder by unit and number, from their paths."""
    files, at = _opened(folder)
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    named = ((PAGE_PATH.search(x.path), x.path) for x in found if x.is_file)
    return sorted((Page(unquote(m[1]), int(m[2]), path) for m, path in named if m), key=lambda p: (p.unit, p.number, p.path))


def _dealt(pages: list[Page], size: int) -> list[Pages]:
    return [Pages(tuple(pages[i : i + size])) for i in range(0, len(pages), size)] or [Pages(())]


def _items(folder: str, part: Pages) -> Iterator[tuple[str, int, str]]:
    files = _opened(folder)[0]
    for page in part.pages:
        with files.open_input_stream(page.path) as said:
            body = json.loads(said.read().decode("utf-8", "replace") or "{}")
        for item in body.get("items", []):
            yield page.unit, page.number, json.dumps(item, ensure_ascii=False)


#: What a comparison with a literal says of a page's own value.
TESTS: dict[type, Callable] = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    GreaterThan: lambda have, want: have > want,
    GreaterThanOrEqual: lambda have, want: have >= want,
    LessThan: lambda have, want: have < want,
    LessThanOrEqual: lambda have, want: have <= want,
}


def _test(f: Filter) -> Callable[[Page], bool] | None:
    """The filter as a test of a page, or None if the paths don't tell. Units and numbers are never null, so a negation is one."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (lambda page: not inner(page))
    if type(f) not in TESTS or f.attribute not in (("unit",), ("page",)):
        return None
    say, name, want = TESTS[type(f)], {"unit": "unit", "page": "number"}[f.attribute[0]], f.value
    if want is None or (isinstance(want, (tuple, list)) and None in want):
        return None
    return lambda page: say(getattr(page, name), want)


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], int(options.get("pagesatask", PAGES_A_TASK))
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        tests = [_test(f) for f in self.kept]
        return _dealt([p for p in _listed(self.folder) if all(t(p) for t in tests)], self.size)

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        return _items(self.folder, partition)


class RecordedStream(DataSourceStreamReader):
    """Offsets are marks: the last page of each unit that has been planned. Pages of a unit come in order of their numbers."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], int(options.get("pagesatask", PAGES_A_TASK))

    def initialOffset(self) -> dict:
        return {"marks": {}}

    def latestOffset(self) -> dict:
        marks: dict[str, int] = {}
        for p in _listed(self.folder):
            marks[p.unit] = max(p.number, marks.get(p.unit, -1))
        return {"marks": marks}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        after, until = start["marks"], end["marks"]
        return _dealt([p for p in _listed(self.folder) if after.get(p.unit, -1) < p.number <= until.get(p.unit, -1)], self.size)

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        return _items(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class RecordedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "unit string, page int, item string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(dict(self.options))

    def streamReader(self, schema) -> RecordedStream:
        return RecordedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSource)
