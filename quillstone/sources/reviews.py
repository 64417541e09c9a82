"""Services that answer by pages, as Python data sources.

A source asks one endpoint for each key (a review, a file of a review, a search) and follows the pages from there. Each key
is a partition of its own, so keys are read side by side and a lost task asks for its own key again; a filter on the key's column (= or IN) is pushed
down and leaves only these keys. A request that fails is tried again, ATTEMPTS times in all, after 1 s and then 2 s; a
page that was answered is not asked for again by its task.

Options: keys (a JSON list), base (what the transport takes as the service's address), project, token, transport (module:function, called
with base, endpoint and headers, returns the answer as parsed JSON or raises; http unless given), wait (seconds of the first pause, 1 unless given).
Register with register(spark).
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

ATTEMPTS = 3


def http(base: str, endpoint: str, headers: dict[str, str]) -> object:
    """The answer of a service, JSON; anything but a success raises."""
    with urllib.request.urlopen(urllib.request.Request(base + endpoint, headers=headers), timeout=60) as r:
        return json.load(r)


def land(answers: DataFrame, folder: str) -> None:
    """Answers (endpoint, value: JSON in one line) into a folder that landed() reads, a file each."""
    rows = answers.select(F.md5(F.col("endpoint").cast("binary")).alias("request"), "value")
    rows.repartition("request").write.partitionBy("request").text(folder)


def landed(base: str, endpoint: str, headers: dict[str, str]) -> object:
    """The answer to a request that land() has put into a folder; all machines have to see it."""
    import pyarrow.fs as fs

    local = base.startswith(("file:", "/"))
    store, path = (fs.LocalFileSystem(), re.sub("^file:/*", "/", base)) if local else fs.FileSystem.from_uri(base)
    files = store.get_file_info(fs.FileSelector(f"{path}/request={hashlib.md5(endpoint.encode()).hexdigest()}"))
    parts = [f.path for f in files if f.base_name.startswith("part-")]
    if len(parts) != 1:
        raise FileNotFoundError(endpoint)
    with store.open_input_stream(parts[0]) as f:
        return json.loads(f.read())


def attempt(ask: Callable[[], object], wait: float = 1.0) -> object:
    """ask(), again after a failure, ATTEMPTS times in all; the last failure is raised."""
    for n in range(1, ATTEMPTS + 1):
        try:
            return ask()
        except Exception:  # noqa: PERF203  whatever a transport raises
            if n == ATTEMPTS:
                raise
            time.sleep(wait * n)
    return None


class Key(InputPartition):
    def __init__(self, value: object):
        super().__init__(value)


class PagedReader(DataSourceReader):
    """Subclasses say which column a key is, where its first page is, and what rows an answer holds."""

    column: str

    def __init__(self, options: dict[str, str]):
        self.keys = json.loads(options["keys"])
        self.base, self.project, self.wait = options.get("base", ""), quote(options.get("project", ""), safe=""), float(options.get("wait", "1"))
        self.headers = {"PRIVATE-TOKEN": options["token"]} if "token" in options else {}
        self.transport = options.get("transport", "quillstone.sources.reviews:http")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.column,):
                self.keys = [k for k in self.keys if self.value(k) == f.value]
            elif isinstance(f, In) and f.attribute == (self.column,):
                self.keys = [k for k in self.keys if self.value(k) in f.value]
            else:
                yield f

    def value(self, key: object) -> object:
        return key

    def partitions(self) -> list[InputPartition]:
        return [Key(k) for k in dict.fromkeys(tuple(k) if isinstance(k, list) else k for k in self.keys)] or [Key(None)]

    def request(self, endpoint: str) -> object:
        module, name = self.transport.split(":")
        ask = getattr(importlib.import_module(module), name)
        return attempt(lambda: ask(self.base, endpoint, self.headers), self.wait)

    def endpoint(self, key: object, page: object) -> str:
        raise NotImplementedError

    def rows(self, key: object, answer: object) -> Iterator[tuple]:
        raise NotImplementedError

    def following(self, page: object, answer: object) -> object:
        """The page after this one, None after the last."""
        return answer.get("next_page") if isinstance(answer, dict) else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        page: object = 1
        while page is not None:
            answer = self.request(self.endpoint(partition.value, page))
            yield from self.rows(partition.value, answer)
            page = self.following(page, answer)


class ChangesReader(PagedReader):
    column = "mr_iid"

    def endpoint(self, key: object, page: object) -> str:
        return f"/projects/{self.project}/merge_requests/{key}/changes" + ("" if page == 1 else f"?page={page}")

    def rows(self, key: object, answer: dict) -> Iterator[tuple]:
        refs = answer.get("diff_refs") or {}
        for c in answer.get("changes") or ():
            yield (key, *[refs.get(n) for n in ("base_sha", "head_sha", "start_sha")], *[c.get(n) for n in ("new_path", "old_path", "diff")], *[bool(c.get(n)) for n in ("new_file", "deleted_file", "renamed_file")])


class FilesReader(PagedReader):
    """Keys are [review, path]; a file that can't be had, or is no base64 of UTF-8, has a null content."""

    column = "path"

    def value(self, key: object) -> object:
        return key[1]

    def endpoint(self, key: object, page: object) -> str:
        return f"/projects/{self.project}/repository/files/{quote(key[1], safe='')}?ref=refs/merge-requests/{key[0]}/head"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        key = partition.value
        try:
            text = base64.b64decode(self.request(self.endpoint(key, 1))["content"]).decode("utf-8")
        except Exception:  # as a missing file is no failure of the scan
            text = None
        yield key[0], key[1], text


class SearchReader(PagedReader):
    """Keys are queries; a page shorter than the size is the last."""

    column = "query"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.size = int(options.get("size", "10"))

    def endpoint(self, key: object, page: object) -> str:
        return f"/search?query={quote(key, safe='')}&page={page}&size={self.size}"

    def rows(self, key: object, answer: dict) -> Iterator[tuple]:
        for p in answer.get("data") or ():
            yield (key, *[p.get(n) for n in ("id", "title", "year", "n_citation", "authors", "venue")])

    def following(self, page: int, answer: dict) -> int | None:
        return page + 1 if len(answer.get("data") or ()) == self.size else None


def _source(name_: str, schema_: str, reader_: type[PagedReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema: object) -> DataSourceReader:
            return reader_(dict(self.options))

    return Source


SOURCES = (
    _source("review_changes", "mr_iid int, base_sha string, head_sha string, start_sha string, new_path string, old_path string, diff string, new_file boolean, deleted_file boolean, renamed_file boolean", ChangesReader),
    _source("review_files", "mr_iid int, path string, content string", FilesReader),
    _source("paper_search", "query string, id string, title string, year int, n_citation bigint, authors array<string>, venue string", SearchReader),
)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets it push filters down to Python sources, which these need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in SOURCES:
        spark.dataSource.register(s)
